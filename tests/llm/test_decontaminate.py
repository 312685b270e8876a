import random

import numpy as np

from attesta.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, doc_id string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n)]


def found(spark, docs, items, **k):
    rows = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **k).collect()
    return {r.doc_id: r for r in rows}


def test_whole_and_partly_changed_passages_are_found(spark):
    item = words(40, 1)
    changed = [w if i % 7 else "zzz" for i, w in enumerate(item)]
    items = [(5, " ".join(item), "x"), (6, " ".join(words(30, 2)), "x")]
    docs = [
        (1, " ".join(words(50, 3) + item + words(50, 4)), "x"),
        (2, " ".join(words(50, 5) + changed + words(10, 6)).upper(), "x"),
        (3, " ".join(words(300, 7)), "x"),
        (4, ", ".join(item[10:30]), "x"),
        (5, " ".join(item[:8]), "x"),
    ]
    got = found(spark, docs, items)
    assert sorted(got) == [1, 2, 4]
    assert got[1].item_ids == [5] and got[1].n_matched == 40 and got[1].start_word == 50 and got[1].score == 1.0
    assert got[2].n_matched == sum(w != "zzz" for w in changed[1:]) and got[2].score < 1


def test_nulls_empties_short_items_and_repeats(spark):
    item = " ".join(words(20, 1))
    items = [(None, item, None), (2, None, None), (3, "", None), (4, "one two", None), (9, item, None), (7, item, None), (8, "alpha beta gamma delta epsilon", None)]
    docs = [(1, item, None), (1, item, None), (None, item, None), (2, None, None), (3, "", None), (4, "one two", None), (5, "so alpha beta gamma delta epsilon it is", None)]
    rows = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 7), (1, 7), (1, 7), (5, 8)]


def test_empty_tables(spark):
    assert not found(spark, [], [(1, "a b c d e", None)])
    assert not found(spark, [(1, "a b c d e", None)], [])


def test_blocks_find_what_one_block_finds(spark):
    items = [(i, " ".join(words(25, i)), None) for i in range(12)]
    docs = [(i, " ".join(words(40, 100 + i) + words(25, i) + words(5, 200 + i)), None) for i in range(12)]
    assert sorted(found(spark, docs, items)) == sorted(found(spark, docs, items, block_bytes=500)) == list(range(12))


def test_items_of_several_blocks_come_in_one_row(spark):
    items = [(i, " ".join(words(20 + i, i)), None) for i in range(12)]
    items += [(20 + i, t.upper().replace(" ", ", "), None) for i, t, _ in items]
    text = " ".join(t for _, t, _ in items[2:9])
    docs = [(1, text, None), (1, text, None), (1, items[0][1], None), (None, text, None), (2, items[1][1] + " and " + items[11][1], None), (3, "none of them", None)]
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = sorted(dc.contaminated(docs, items).collect(), key=str)
    assert len(one) == 5 and sorted(len(r.item_ids) for r in one) == [1, 2, 7, 7, 7]
    several = dc.contaminated(docs, items, block_bytes=1000)
    assert sorted(several.collect(), key=str) == one and several.columns == dc.contaminated(docs, items).columns


def test_clean_keeps_other_columns_and_clean_rows(spark):
    item = " ".join(words(20, 1))
    docs = spark.createDataFrame([(1, "x " + item, "a"), (2, "y z", "b"), (None, None, None)], DOCS)
    left = dc.clean(docs, spark.createDataFrame([(1, item, None)], ITEMS))
    assert left.schema == docs.schema
    assert sorted(left.collect(), key=str) == sorted(docs.where("doc_id = 2 or doc_id is null").collect(), key=str)


def test_any_stretch_of_a_diagonal_may_meet_the_rules(spark):
    short, long = words(15, 1), words(57, 2)
    trimmed = ["zzz" if i in (1, 13) else w for i, w in enumerate(short)]
    diluted = ["zzz" if 15 <= i < 23 or 36 <= i < 44 else w for i, w in enumerate(long)]
    below = ["zzz" if 11 <= i < 19 else w for i, w in enumerate(long[:30])]
    docs = [(i, " ".join(words(20, 10 + i) + x + words(20, 20 + i)), None) for i, x in enumerate((trimmed, diluted, below))]
    got = found(spark, docs, [(5, " ".join(short), None), (6, " ".join(long), None)])
    assert sorted(got) == [0, 1]
    assert (got[0].item_id, got[0].start_word, got[0].n_words, got[0].n_matched) == (5, 20, 15, 13)
    assert (got[1].item_id, got[1].start_word, got[1].n_words, got[1].n_matched) == (6, 20, 36, 28)


def test_stretches_are_those_of_all_pairs_of_ends():
    r = np.random.default_rng(1)
    for _ in range(2000):
        same = r.random(r.integers(4, 50)) < r.uniform(0.4, 0.9)
        some = [(a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a:b].sum() >= max(12, 0.75 * (b - a))]
        got = dc._stretch(same, 12, dc.Rules())
        assert got in some if some else got is None


def test_a_very_long_text(spark):
    item = words(30, 1)
    text = " ".join(words(20, 2) * 20_000 + item)
    got = found(spark, [(1, text, None)], [(1, " ".join(item), None)])
    assert got[1].start_word == 400_000
