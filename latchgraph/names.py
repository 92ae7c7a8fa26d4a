"""Names that tie the analysis to its users' files."""

TOOL = "latchgraph"  # [tool.latchgraph] in pyproject.toml
ANNOTATIONS = "latchgraph"  # the package whose blocking, non_blocking and unblocker are understood
PREFIX = "LATCH"  # of diagnostic codes
VERSION = "0.1.0"
REPORT_VERSION = "1.0"
