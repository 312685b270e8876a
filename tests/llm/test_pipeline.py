import random

import numpy as np
import public_tokenizers
from test_line_dedup import plain as plain_lines
from test_ngram_join import classes
from test_toxicity import sentence
from tokenizers import Tokenizer

import corpus_pipeline as cp
from attesta.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    r = random.Random(8)
    docs = [(i, "\n".join(sentence(r, i % 6 == 0, 12) for _ in range(3))) for i in range(300)]
    item = sentence(r, False, 30)
    docs.append((400, sentence(r, False, 20) + "\n" + item))
    docs += [(401 + k, docs[7][1].replace("\n", " ") + f" end{k}") for k in range(5)]
    docs += [(500 + k, f"a line that all of these hold\n{sentence(r, False, 10)}") for k in range(4)]
    docs += [(600, None), (601, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_each_stage_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    docs = fixture(spark, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in cp.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        left[name] = now.collect()
        if name != "packing":
            assert [(f.name, f.dataType) for f in now.schema] == [(f.name, f.dataType) for f in spark.read.parquet(f"{folder}/documents.parquet").schema]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    score = {r.doc_id: r.score for r in toxicity.scored(frame, toxicity.fitted(frame, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    kept = [(i, t) for i, t in docs if score[i] < 0.3]
    assert {r.doc_id for r in left["toxicity"]} == {i for i, _ in kept}
    toxic = {i for i in range(0, 300, 6)}
    assert len(toxic & {i for i, _ in kept}) <= 3 and len({i for i, _ in docs} - toxic - {i for i, _ in kept}) <= 3

    lines = {i: t for i, _, _, t in plain_lines(kept, 10)}
    assert {r.doc_id: r.text for r in left["line_dedup"]} == lines
    assert all(r.n_chars == len(r.text) for r in left["line_dedup"])

    own = classes(sorted(lines.items()), 5, 4, 5)
    distinct = {i: t for i, t in lines.items() if own[i][1] == i}
    assert {r.doc_id: r.text for r in left["ngram_join"]} == distinct and len({401, 402, 403, 404, 405, 7} & set(distinct)) <= 1

    clean = {i: t for i, t in distinct.items() if i != 400}
    assert {r.doc_id: r.text for r in left["decontaminate"]} == clean

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert {r.doc_id: r.length for r in left["packing"]} == counts
    assert np.max([r.offset + r.length for r in left["packing"]]) <= 4096


def test_run_is_the_stages(spark, tmp_path):
    folder = str(tmp_path)
    fixture(spark, folder)
    rows = cp.run(spark, folder).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
