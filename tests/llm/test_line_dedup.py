import random

from attesta.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, kept string"
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(docs, least):
    holders = {}
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def got(spark, docs, least=4):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    return sorted(map(tuple, ld.line_dedup(frame, least).collect()), key=str)


def test_lines_go_as_in_plain_python(spark):
    r = random.Random(2)
    pool = ["one line", " One Line ", "two", "thrée", "Éa b c", "", "  ", "a\tb c\r", "long enough line", "LONG ENOUGH LINE\x0b"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(60)]
    docs += [(None, "one line\ntwo"), (200, None), (201, ""), (3, docs[3][1]), (4, "one line\nother")]
    assert got(spark, docs) == plain(docs, 4)


def test_a_very_long_text(spark):
    text = "\n".join(f"line number {i}" for i in range(30_000))
    rows = got(spark, [(1, text), (2, text + "\nlast one here")])
    assert [x[1:3] for x in rows] == [(30_000, 0), (30_001, 30_000)] and rows[1][3] == "last one here"


def test_an_empty_table(spark):
    assert got(spark, []) == []


def test_deduplicated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "same line here\nx", "a", 16), (2, "Same line here\ny", "b", 16), (None, None, None, None)], "doc_id long, text string, `odd name` string, n_chars long")
    left = ld.deduplicated(docs, 4, length_col="n_chars")
    assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(tuple, left.collect()), key=str) == [(1, "same line here\nx", "a", 16), (2, "y", "b", 1), (None, "", None, 0)]


def test_only_dataframe_functions(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ld.line_dedup(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
