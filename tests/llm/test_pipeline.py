"""run() against the stages applied by hand to collected rows, on the smallest tables and on odd ones."""

import pytest
from test_similar import jaccard

import corpus_pipeline
from cohortloom.llm import decontaminate, quality, sentencepiece, simhash
from cohortloom.llm.common import read
from cohortloom.llm.queries import tokenizer_file


def by_hand(spark, sf):
    """{id: ids} for tables whose ids are distinct and not null."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    ranker = quality.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {i: t for i, t in texts.items() if ranker.score(quality.feature_matrix([t]))[0] >= quality.CUT}
    last = {t: i for i, t in sorted(good.items())}
    left = {i: t for t, i in last.items()}
    # one document of each group by true Jaccard similarity of five-word shingles
    sets, root = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in left.items()}, {i: i for i in left}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if j < i and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    one = {i: t for i, t in left.items() if top(i) == i}
    blocks = [*decontaminate.compile_blocks(((r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()), 13, 1 << 30)]
    bad = {i for b in blocks for i, (n, hit, _) in zip(one, decontaminate.scan_texts([*one.values()], b), strict=True) if decontaminate.is_contaminated(n, len(hit))}
    encoder = sentencepiece.Encoder(sentencepiece.Model(tokenizer_file("piece_bpe_32k.model")))
    return {i: encoder.encode(t).tolist() for i, t in one.items() if i not in bad}, len(left) - len(one), len(bad)


def test_run(spark, sf):
    want, near, bad = by_hand(spark, sf)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and bad
    print(near, "near-duplicates,", bad, "contaminated")


@pytest.fixture(scope="module")
def odd_dir(spark, sf, tmp_path_factory):
    """The smallest tables with nulls in every column, empty and long texts, repeated rows, and columns whose names clash with those of operators."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs = read(spark, sf, "documents")
    schema = docs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    some = docs.where("length(text) > 900").orderBy("doc_id").limit(3).collect()
    long = " ".join(r.text for r in some) * 30
    odd = [(None, None, None, None, None), (None, some[0].text + " more", None, None, 1), (900_001, None, "en", "x", 0), (900_002, "", None, "x", 0), (900_003, long, "en", "x", 0), (900_003, long, "en", "x", 0), (900_003, some[1].text + " another end", "en", None, None)]
    extra = docs.unionByName(spark.createDataFrame(odd, schema))
    extra.selectExpr("*", "'a' AS KEPT", "1 AS _c0", "2 AS _id", "3 AS _k1", "'b' AS Text2", "4 AS keep_id", "5 AS h").write.parquet(f"{path}/documents.parquet")
    for table in ("labels", "benchmark"):
        read(spark, sf, table).write.parquet(f"{path}/{table}.parquet")
    return path


def test_odd_rows(spark, odd_dir):
    docs, dropped = read(spark, odd_dir, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_dir)
        assert docs.columns == columns
        dropped.append((name, docs.count()))
    assert all(a[1] >= b[1] for a, b in zip(dropped, dropped[1:], strict=False))
    rows = corpus_pipeline.run(spark, odd_dir).collect()
    assert len(rows) == dropped[-1][1] and sum(r.doc_id == 900_003 for r in rows) <= 2
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)


def test_empty_tables(spark, odd_dir, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        read(spark, odd_dir, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
