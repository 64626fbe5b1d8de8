import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, `Shard` string, k int, `a.b` int"


def prose(seed: int, n: int) -> str:
    """Invented sentences, some to a line."""
    draw = random.Random(seed)
    words = ["".join(draw.choice(["ba", "du", "ké", "lo", "mi", "ra", "st", "ün"]) for _ in range(draw.randint(1, 4))) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        size = draw.randint(6, 14)
        lines.append(" ".join(words[at : at + size]).capitalize() + ".")
        at += size
    return "\n".join(" ".join(lines[i : i + 2]) for i in range(0, len(lines), 2))


def rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, common lines and passages, ties and repeated rows."""
    base, passage = prose(1, 200), prose(2, 60).replace("\n", " ")
    near = base.split(" ")
    near[40] = "changed"
    texts = [base, base, " ".join(near), base.upper(), prose(3, 30), "", None, "  \n\t ", "one two three", "One  two\nTHREE"]
    texts += [f"{prose(10 + i, 80)}\n{passage}\n{prose(30 + i, 80)}" for i in range(4)]
    texts += [f"{prose(50 + i, 40)}\nThis line is common to several documents.\n  this LINE is common to several documents.  \nshort line\n{prose(60 + i, 20)}" for i in range(5)]
    texts += ["word " * 3000, prose(70, 30_000), "x" * 20_000, "İstanbul ΣΑΣ é ² naïve <|endoftext|> it's 12,5 ×÷ \x1c end", "漢字 かな 漢字 한국어 текст 1234 ½"]
    out = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", None if t is None else len(t), "x", "y", "z", i, 1) for i, t in enumerate(texts)]
    out += [(3, None, None, None, None, None, None, None, None, None), out[0], out[0], (None, base, "en", "s0", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def plain(spark):
    """Without null ids and repeated ids, as lists of (doc_id, text)."""
    seen = {}
    for row in rows():
        if row[0] is not None:
            seen.setdefault(row[0], row[1])
    return list(seen.items())


@pytest.fixture(scope="session")
def plain_docs(spark, plain):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in plain], "doc_id long, text string, lang string, source string").repartition(3).cache()
