"""The corpus pipeline, as a whole and stage by stage, against plain versions and on odd tables."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanweave.llm import pii, toxicity

from test_text_operators import components, prose, sets_of, toxic_corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def inputs():
    """Documents with toxic words, copies, a benchmark item, personal data, odd rows and repeated ones."""
    rnd, (rows, marks) = random.Random(12), toxic_corpus()
    rows = rows[:200]
    item = prose(rnd, 30)
    near = prose(rnd, 80)
    rows += [(400 + k, f"{near} {prose(rnd, k)}") for k in range(4)]
    rows += [(410, rows[1][1]), (411, f"{prose(rnd, 50)} {item} {prose(rnd, 50)}"), (412, "Mail anna@example.com or +1 (212) 555-0123, " + prose(rnd, 20)), (413, None), (414, ""), (415, prose(rnd, 9000)), (416, "a <|endoftext|> b " + prose(rnd, 10)), (None, "without id"), (412, "two"), (3, rows[3][1])]
    return rows, [m for m in marks if m[0] < 200], [(1, item), (2, None), (3, "")]


def written(spark, path, rows, marks, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def ids_of(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_stages_against_plain_versions(spark, tmp_path):
    rows, marks, items = inputs()
    sf_dir = written(spark, tmp_path, rows, marks, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, toxicity.learn_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    # 1: the scores (held against brute force in their own test) decide
    scores = model.score(pa.array([t or "" for _, t in rows]))[0]
    want = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    assert {i for i, _ in rows[:200] if i % 6 == 0} == {i for i, _ in rows[:200]} - {i for i, _ in want}
    plain = [want]
    # 2: one row of each group
    first = {}
    for r, c, s in zip(want, components(want, 5, 80), sets_of(want, 5), strict=True):
        if r[0] is None or r[0] == c[2]:
            first.setdefault((r[0], frozenset(s) or r[1]), r)
    plain.append(list(first.values()))
    # 3: none with a benchmark item
    found = [s for s in sets_of(items, 5) if s]
    plain.append([r for r, s in zip(plain[1], sets_of(plain[1], 5), strict=True) if not any(100 * len(x & s) >= 80 * len(x) for x in found)])
    # 4: pseudonyms
    p = pii.Permuter(corpus_pipeline.PII_KEY)
    plain.append([(i, t if t is None else pii.replace(p, t)[0]) for i, t in plain[2]])
    assert [len(x) for x in plain] == sorted((len(x) for x in plain), reverse=True) and len({len(x) for x in plain}) == 3
    for (name, stage), rows_ in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == collections.Counter(rows_), name
    # 5: every id lies in one piece, no padding
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), corpus_pipeline.run(spark, sf_dir).collect()):
        have, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in pieces:
            have[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            size = 0
            for at, n in sorted(parts):
                assert at == size
                size += n
            assert size <= 2048 and size & (size - 1) == 0
        texts = dict(plain[-1])
        assert set(have) == set(texts)
        for (i, t), ids in zip(plain[-1], ids_of(t for _, t in plain[-1]), strict=True):
            if sum(d == i for d, _ in plain[-1]) == 1:
                at = 0
                for r in sorted(have[i], key=lambda r: r.start):
                    assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                    at += r.length
                assert at == len(ids)


@pytest.mark.parametrize("kind", ["empty", "null", "alike"])
def test_odd_tables(spark, tmp_path, kind):
    rows = {"empty": [], "null": [(None, None)] * 3, "alike": [(5, "the same words in every row of it")] * 3 + [(6, "the same words in every row of it")]}[kind]
    sf_dir = written(spark, tmp_path, rows, [], [])
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], SCHEMA + ", probe_text string, node long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n == (1 if kind == "alike" and name == "ngram_jaccard_join" else len(rows)), name
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in pieces) == {"empty": 0, "null": 3, "alike": len(ids_of(["the same words in every row of it"])[0])}[kind]
    assert corpus_pipeline.ORACLE_SQL is None


def test_key_is_a_setting(spark):
    docs = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
    public = corpus_pipeline.pseudonymise(spark, docs, "").first().text
    spark.conf.set(corpus_pipeline.KEY_SETTING, "another")
    try:
        assert corpus_pipeline.pseudonymise(spark, docs, "").first().text == pii.replace(pii.Permuter(b"another"), "10.1.2.3")[0] != public
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
