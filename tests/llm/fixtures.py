"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, component_id string, __row int"
SOUNDS = {"en": "the of and ing tion er on".split(), "de": "der und ein sch ung ver ich".split()}


def sentence(r: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(n: int = 120, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    passage = sentence(r, "en", 60)
    rows = []
    for i in range(n):
        lang = r.choice(("en", "en", "de"))
        text = sentence(r, lang, r.randint(1, 160))
        if i % 10 == 4:
            text = passage + "\n" + text
        if i % 12 == 7:
            words = rows[i - 3][1].split(" ")
            if len(words) > 30:
                words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 15 == 8:
            text = rows[i - 8][1]
        rows.append((i * 3, text, lang, f"src{r.choice((0, 0, 0, 1, 2))}"))
    return rows


def odd() -> list[tuple]:
    r = random.Random(9)
    long = sentence(r, "de", 9000)
    return [
        (1000, None, "en", "src0"),
        (1001, "", "en", None),
        (1002, " \t\n\x0b\x0c\r ", None, "src1"),
        (1003, "one", "en", None),
        (1004, "One two", "en", "src0"),
        (1005, "123 456 --- !!!", "en", "src2"),
        (1006, long, "de", "src0"),
        (1006, long, "de", "src0"),
        (1007, "ÀÉ œuvre\u00a0x 中文 \U0001f600 ǅ", None, "é"),
        (1008, "a b " * 40, "en", "src0"),
        (None, "the of and the of and the of and " * 9, "en", "src0"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 1) for r in rows], DOCS)
