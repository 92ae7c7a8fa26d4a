"""Reports as JSON, text and SARIF: ``report`` and ``as_*`` for documents in memory, ``pieces`` for documents of any size."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import PREFIX, REPORT_VERSION, TOOL, VERSION
from ..session import cut, ship, sized
from .windows import numbered, ranged

# fixed values: rule names and descriptions, and the SARIF schema's address
RULES = (
    ("DirectBlockingInAsync", "Direct blocking call in async function"),
    ("TransitiveBlockingInAsync", "Transitive blocking call reachable from async context"),
    ("BlockingPropertyInAsync", "Blocking @property getter accessed in async context"),
    ("BlockingDunderInAsync", "Blocking dunder invocation in async context"),
)
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
NOTHING = "No blocking issues found"
FIELDS = ("code", "severity", "message", "primary_location", "related_locations", "chain", "help", "intervention_strategy")


def _finding(d: dict) -> dict:
    return {k: d[k] for k in FIELDS}


def _warning(w: dict) -> dict:
    return {"message": w["message"]} | ({"file": w["file"]} if w.get("file") is not None else {})


def report(diagnostics: list[dict], warnings: list[dict]) -> dict:
    """The report document; ``diagnostics`` and ``warnings`` in order."""
    return {"version": REPORT_VERSION, "diagnostics": [_finding(d) for d in diagnostics], "warnings": [_warning(w) for w in warnings]}


def as_json(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def as_text(document: dict) -> str:
    lines = [_told(d) for d in document["diagnostics"]] or [NOTHING]
    return "\n".join(lines + [_warned(w) for w in document["warnings"]]) + "\n"


def _told(d: dict) -> str:
    at = d["primary_location"]
    return f"{at['file']}:{at['line']}:{at['column']}: {d['severity']} {d['code']}: {d['message']}\n  help: {d['help']}"


def _warned(w: dict) -> str:
    return f"warning: {w['file']}: {w['message']}" if w.get("file") is not None else f"warning: {w['message']}"


def exit_code(diagnostics: int) -> int:
    """0 without diagnostics, else 1; configuration errors and missing sources have codes of their own (2 and 3)."""
    return int(diagnostics > 0)


def exit_codes(diagnostics: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, exit_code) of every project."""
    hit = diagnostics.select("project").distinct().withColumn("__hit", F.lit(1))
    return projects.join(hit, "project", "left").select("project", F.coalesce("__hit", F.lit(0)).alias("exit_code"))


def _place(file: str, **region: int) -> dict:
    return {"physicalLocation": {"artifactLocation": {"uri": file}, "region": region}}


def _result(d: dict) -> dict:
    at = d["primary_location"]
    one = {"ruleId": d["code"], "level": d["severity"], "message": {"text": d["message"]}, "locations": [_place(at["file"], startLine=at["line"], startColumn=at["column"])]}
    if d["related_locations"]:
        one["relatedLocations"] = [{"id": i, "message": {"text": x["message"]}, **_place(x["file"], startLine=x["line"], startColumn=x["column"])} for i, x in enumerate(d["related_locations"], 1)]
    if d["chain"]:
        steps = [{"location": {"message": {"text": x["function"]}, **_place(x["file"] or "<external>", startLine=x["line"] or 1)}} for x in d["chain"]]
        one["codeFlows"] = [{"threadFlows": [{"locations": steps}]}]
    return one


def as_sarif(document: dict) -> str:
    results = [_result(d) for d in document["diagnostics"]]
    rules = [{"id": f"{PREFIX}{i:03}", "name": n, "shortDescription": {"text": t}} for i, (n, t) in enumerate(RULES, 1)]
    driver = {"name": TOOL, "version": VERSION, "rules": rules}
    return as_json({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]})


FORMATS = {"json": as_json, "text": as_text, "sarif": as_sarif}


def text_lines(diagnostics: DataFrame) -> DataFrame:
    """(project, line) of the text report, for writing large reports without a driver."""
    at = F.col("primary_location")
    return diagnostics.select("project", F.format_string("%s:%d:%d: %s %s: %s", at["file"], at["line"], at["column"], "severity", "code", "message").alias("line"))


def json_lines(diagnostics: DataFrame) -> DataFrame:
    """(project, value): one JSON object per diagnostic."""
    return diagnostics.select("project", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("value"))


# documents of any size

#: Of each form: how a diagnostic and a warning are written, how deep they stand, and what stands around their lists.
_FORMS = {
    "json": (lambda d: json.dumps(_finding(d), indent=2, ensure_ascii=False), lambda w: json.dumps(_warning(w), indent=2, ensure_ascii=False), 4),
    "sarif": (lambda d: json.dumps(_result(d), indent=2, ensure_ascii=False), None, 8),
    "text": (_told, _warned, 0),
}


def _around(kind: str, found: bool, told: bool) -> tuple[str | None, str | None, str | None]:
    """The text before the diagnostics, between them and the warnings, and after those; lists without members are closed at once."""
    if kind == "text":
        return None if found else NOTHING, None, None
    shell = FORMATS[kind](report([], []))[:-1]
    head, tail = shell.split('"results": []' if kind == "sarif" else '"diagnostics": []')
    close = " " * (_FORMS[kind][2] - 2) + "]"
    name = '"results": ' if kind == "sarif" else '"diagnostics": '
    opened = lambda some: "[" if some else "[]"
    if kind == "sarif":
        return head + name + opened(found), None, close + tail if found else tail[1:]
    between, end = tail.split("[]")
    before = (close if found else "") + between + opened(told)
    return head + name + opened(found) + ("" if found else before), before if found else None, close + end if told else end[1:]


def _written(rows: DataFrame, kind: str, section: int) -> DataFrame:
    """(document, section, place, text) of diagnostics (1) or warnings (3); list members but the last end in a comma."""
    form, deep = _FORMS[kind][section // 2], _FORMS[kind][2]
    schema = pa.schema([("document", pa.string()), ("section", pa.int32()), ("place", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = form(r)
                if deep:
                    text = " " * deep + text.replace("\n", "\n" + " " * deep) + ("" if r["place"] == r["last"] else ",")
                out.append({"document": r["document"], "section": section, "place": r["place"], "text": text})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, "document string, section int, place long, text string")


def _placed(rows: DataFrame, documents: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``place`` in the order of all documents and the ``last`` place of their document, and (document, last)."""
    keys = [c.alias(f"__{i}") for i, c in enumerate(order)]
    keyed = rows.join(sized(documents), "project").select("*", *keys)
    names = ["document", "position", *[f"__{i}" for i in range(len(order))]]
    stored, offsets = ranged(keyed, names)
    # a range has its rows by document, so the last place of a document follows from counts, without sorting the rows once more
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("document"))
    ends = stored.groupBy("__part", "document").agg(F.count("*").alias("__n")).withColumn("__upto", upto).join(offsets, "__part")
    last = sized(cut(ends.groupBy("document").agg(F.max(F.col("__before") + F.col("__upto") - 1).alias("last"))))
    return numbered(stored, offsets, names, "place").join(last, "document").drop(*names[1:]), last


def pieces(diagnostics: DataFrame, warnings: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    """(document, section, place, text): the lines of documents, which are whole in the order of section and place.

    ``documents`` has project, document and position: the document that tells of a project, and the project's place in
    it; it is as large as the number of projects.  Executors write the members of the lists; what stands around the
    lists depends on nothing but whether there are any.  A document is equal to what ``as_*`` makes of it.
    """
    spark = ship(diagnostics.sparkSession)
    at = F.col("primary_location")
    found, some = _placed(diagnostics, documents, [at["file"], at["line"], at["column"], F.col("code"), F.col("chain"), F.col("message")])
    # a missing file comes first
    told, any_told = _placed(warnings, documents, [F.col("file").isNotNull(), F.coalesce("file", F.lit("")), F.col("message")])
    flags = documents.select("document").distinct().join(some.select("document", F.lit(True).alias("found")), "document", "left").join(any_told.select("document", F.lit(True).alias("told")), "document", "left")
    forms = [(f, t, section, text) for f in (False, True) for t in (False, True) for section, text in zip((0, 2, 4), _around(kind, f, t), strict=True) if text is not None]
    around = F.broadcast(spark.createDataFrame(forms, "found boolean, told boolean, section int, text string"))
    frame = flags.na.fill(False, ["found", "told"]).join(around, ["found", "told"]).select("document", "section", F.lit(0).cast("long").alias("place"), "text")
    out = frame.unionByName(_written(found, kind, 1))
    return out.unionByName(_written(told, kind, 3)) if kind != "sarif" else out


def ordered_pieces(made: DataFrame) -> DataFrame:
    return made.orderBy("document", "section", "place")


def write(made: DataFrame, where: str) -> None:
    """Writes every document to a folder ``document=...`` of text files that, in the order of their names, are the document."""
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["document", "section", "place"]
    made.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("document", "text").write.partitionBy("document").text(where)
