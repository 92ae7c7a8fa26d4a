"""Questions on single places of the source: what a call, a reference, an attribute or an operator there stands for.

``index`` resolves all references once; ``save`` keeps them sorted by file and place, so that a question on a saved
index reads the row groups of its file and joins nothing.  ``answers`` takes any number of questions at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import resolve

#: Of each question the kinds of references that it is about.
QUESTIONS = {"call": ("call",), "callable": ("call", "attribute", "decorator"), "attribute": ("attribute",), "property": ("attribute",), "dunder": ("implicit",), "executor": ()}
PLACE = ["project", "path", "line", "column"]
TARGETS = "array<string>"
#: Columns of the syntax facts that an index is made from.
FACTS = "project path fact module is_stub name qualified_name enclosing kind target is_async decorators bases start end line column"


def listed(files: DataFrame) -> DataFrame:
    """The rows of an index that tell which files (project, path) there are."""
    none = [F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast(TARGETS).alias("answer")]
    return files.select("project", "path", *none)


def index(facts: DataFrame, files: DataFrame, by: resolve.Lookup | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(project, path, line, column, kind, answer) of all references and, without a kind, of each of ``files`` (project, path).

    An answer is the identity of a function of the project, else the outside names that may be meant.  A member that
    no class of the project has is looked for in the outside classes that they inherit from.

    With ``asked`` (project, path, line, column) the index has the references at these places alone, and only what they name is
    resolved.
    """
    if asked is not None:
        here = cut(facts.filter("fact = 'reference' and target is not null").join(asked.select(*PLACE).distinct(), PLACE, "left_semi"))
        facts = facts.filter("fact != 'reference'").unionByName(here)
    by = by or resolve.lookup(facts, handed=False)
    located = resolve.located(by.resolved, by)
    owned = by.classes.select("project", F.col("class").alias("__class"), F.lit(True).alias("__owned"))
    located = located.withColumn("__class", F.regexp_extract("resolved", r"^(.*)\.[^.]*$", 1)).join(owned, ["project", "__class"], "left")
    outside = F.when(F.coalesce("__owned", F.lit(False)), F.array_remove("names", F.col("resolved"))).otherwise(F.col("names"))
    answer = F.when(F.col("identity").isNotNull(), F.array("identity")).otherwise(outside)
    meant = located.select("project", "target", answer.alias("answer"))
    places = facts.filter("fact = 'reference' and target is not null").select(*PLACE, "kind", "target").join(meant, ["project", "target"]).select(*PLACE, "kind", "answer")
    return places.unionByName(listed(files))


def save(rows: DataFrame, where: str) -> None:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *PLACE).sortWithinPartitions(*PLACE).write.mode("overwrite").parquet(where)


def load(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(where)


def answers(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (project, path, line, column, question) with ``known``, whether there is such a file, and ``answer``.

    The answer is a sorted array, empty where nothing is known of the place, null where the file is unknown.
    Whether a call leads to an event loop's executor is always denied, so ``executor`` gives no answers.
    """
    kinds = F.create_map(*[x for q, k in QUESTIONS.items() for x in (F.lit(q), F.lit(",".join(k)))])
    meant = rows.filter("kind is not null").select(*[F.col(c).alias(f"__{c}") for c in PLACE], F.col("kind").alias("__kind"), "answer")
    on = [F.col(c) == F.col(f"__{c}") for c in PLACE]
    one = asked.select(*PLACE, "question").distinct()
    hits = one.join(meant, [*on, F.find_in_set(F.col("__kind"), F.element_at(kinds, F.col("question"))) > 0])
    found = hits.select(*PLACE, "question", F.explode("answer").alias("a")).groupBy(*PLACE, "question").agg(F.array_sort(F.collect_set("a")).alias("answer"))
    files = rows.filter("kind is null").select("project", "path").distinct().withColumn("known", F.lit(True))
    out = asked.join(files, ["project", "path"], "left").join(found, [*PLACE, "question"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return out.withColumn("answer", F.when(F.col("known"), F.coalesce("answer", F.array().cast(TARGETS))))


def answer(rows: DataFrame, project: str, path: str, question: str, line: int, column: int) -> list[str] | None:
    """The answer to one question: a filter on place, which a saved index meets from a few row groups."""
    here = rows.filter((F.col("project") == project) & (F.col("path") == path))
    kinds = QUESTIONS[question]
    found = here.filter((F.col("line") == line) & (F.col("column") == column) & F.col("kind").isin(*kinds)) if kinds else here.limit(0)
    # the references of one place
    told = sorted({a for r in found.select("answer").collect() for a in r["answer"]})
    return told if told or here.filter("kind is null").limit(1).count() else None
