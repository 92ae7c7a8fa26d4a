"""The built-in table of blocking callables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: names and categories of blocking callables of the standard library and common packages
SLEEP = "time.sleep"
NETWORK = """
requests.get requests.post requests.put requests.delete requests.patch requests.head requests.options requests.request
requests.Session.get requests.Session.post requests.Session.put requests.Session.delete requests.Session.patch
requests.Session.head requests.Session.options requests.Session.request requests.Session.send
urllib.request.urlopen http.client.HTTPConnection.request http.client.HTTPSConnection.request
socket.socket.connect socket.socket.recv socket.socket.send socket.socket.accept socket.socket.sendall
socket.socket.recvfrom socket.create_connection
"""
FILES = """
builtins.open io.open os.read os.write os.fdopen
pathlib.Path.read_text pathlib.Path.read_bytes pathlib.Path.write_text pathlib.Path.write_bytes
os.listdir os.scandir os.stat os.path.exists os.path.isfile os.path.isdir
glob.glob glob.iglob shutil.copy shutil.copytree shutil.move shutil.rmtree
"""
SUBPROCESS = """
subprocess.run subprocess.call subprocess.check_call subprocess.check_output
subprocess.Popen.wait subprocess.Popen.communicate os.system os.popen
"""
DATABASE = "psycopg2.connect sqlite3.connect pymysql.connect"
INPUT = "builtins.input"
CATEGORIES = ("sleep", "network-io", "file-io", "subprocess", "database-io", "user-input", "other")
# fixed values: methods of socket objects that C code names by their implementation module
SOCKET_METHODS = "connect recv send accept sendall recvfrom"

_ADVICE = {
    "sleep": "Await asyncio.sleep() instead.",
    "network-io": "Use an asynchronous client, or hand the call to a thread.",
    "file-io": "Hand file access to a thread.",
    "subprocess": "Use asyncio's subprocess functions.",
    "database-io": "Use an asynchronous driver, or hand the call to a thread.",
    "user-input": "Read input in a thread.",
    "other": "Hand the call to a thread.",
}


def rows() -> list[tuple[str, str, str]]:
    """(name, help, category) of every entry."""
    groups = zip((SLEEP, NETWORK, FILES, SUBPROCESS, DATABASE, INPUT), CATEGORIES, strict=False)
    return [(name, _ADVICE[category], category) for names, category in groups for name in names.split()]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "name string, help string, category string")


def implementation_aliases() -> list[tuple[str, str]]:
    """(alias, name) of the methods that are known under another name as well."""
    return [(f"_socket.socket.{m}", f"socket.socket.{m}") for m in SOCKET_METHODS.split()]
