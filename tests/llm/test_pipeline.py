import corpus_pipeline as p
from quaylark.llm import toxicity
from quaylark.llm.hilbert_packing import encoder, token_ids
from quaylark.llm.quality import score_quality
from quaylark.llm.queries import held_out
from tests.llm.test_operators import brute_components, docs, near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        after = stage(spark, docs, SF).cache()
        kept = {r["doc_id"] for r in after.collect()}
        assert after.columns == docs.columns and kept <= before and after.count() == len(kept)
        if name == "quality":
            assert sum((i in kept) == (labels[i]["quality"] == 1) for i in before & labels.keys()) >= 0.95 * len(before & labels.keys())
        docs = after
    rows = p.packing(spark, docs, SF).collect()
    total = sum(len(token_ids(r["text"], encoder())) for r in docs.collect())
    assert sum(r["length"] for r in rows) == total


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def brute_line_texts(texts, percent=80):
    """Texts without the lines that have an earlier match; None where lines went and no word stays."""
    lines = [(i, k, x, set(x.split())) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    gone = {(i, k) for q, (i, k, _, s) in enumerate(lines) if s and any(r and 100 * len(r & s) >= percent * len(r | s) for *_, r in lines[:q])}
    out = []
    for i, t in enumerate(texts):
        kept = "\n".join(x for j, k, x, _ in lines if j == i and (j, k) not in gone)
        out.append(t if not any(j == i for j, _ in gone) else kept if kept.strip() else None)
    return out


def fixture():
    """Documents of near lines, then near documents, then one of nothing but earlier lines."""
    texts = ["\n".join(near_copies(s, 8)) for s in range(8)] + near_copies(1, 40)
    return [*texts, texts[0], ""]


def test_line_stage(spark):
    texts = fixture()
    want = {i: t for i, t in enumerate(brute_line_texts(texts)) if t is not None}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in p.line_dedup(spark, docs(spark, texts), SF).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and len(want) < len(texts)


def test_near_duplicates_stage(spark):
    texts = fixture()
    roots, _ = brute_components(texts)
    want = {(i, t) for i, t in enumerate(texts) if roots[i] == i}
    got = [(r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs(spark, texts), SF).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(texts)


def test_stages_repeated_ids(spark):
    """Rows that repeat an id with texts of their own, linked or not, and as exact copies; null ids."""
    one, two, three = "a b c d e f g h", "q r s t u v w x", "one two three four five"
    ids, texts = [1, 1, 2, 3, 3, 4, 4, None, None], [f"{one}\nx y", f"{two}\n{one}", three, one, "i j k l m", "", "", one, one]
    lines = p.line_dedup(spark, docs(spark, texts, ids), SF)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.collect())
    assert got == sorted([(0, one), (0, one), (1, f"{one}\nx y"), (1, two), (2, three), (3, "i j k l m"), (4, ""), (4, "")])
    texts = [one, two, three, two, "i j k l m", "", "", one, one]
    near = p.near_duplicates(spark, docs(spark, texts, ids), SF)
    assert near.columns == docs(spark, texts, ids).columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in near.collect())
    assert got == sorted([(0, one), (0, one), (1, one), (1, two), (2, three), (3, "i j k l m"), (4, "")])


def test_toxic_stage(spark):
    """The stage's rows are those that the learnt grammar scores below 0.5, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    g = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    want = {r["doc_id"] for r in docs.collect() if toxicity.score(r["text"], g) < 0.5}
    assert {r["doc_id"] for r in p.toxicity(spark, docs, SF).collect()} == want


def test_quality_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"] for r in score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("good = 1").collect()}
    assert {r["doc_id"] for r in p.quality(spark, docs, SF).collect()} == want


def test_odd_columns_and_ids(spark):
    """Columns with dots and with names that stages use, null and repeated ids, a null, an empty and a long text."""
    one = "The first of these lines has quite a number of words.\nAnd the second has some others."
    texts = [one, None, "", "word " * 60_000, one, "Another text of a few words follows here.", one]
    ids = [1, 2, 3, 4, 5, 6, None]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row_number int, row0 int, gone0 int, id int, score double"
    for own in (ids, [1, 1, 3, 4, 5, 6, None]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, 77, 1, 2, 3, 0.5) for n, (i, t) in enumerate(zip(own, texts, strict=True))], schema)
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert out.columns == docs.columns and {r["row_number"] for r in rows} <= {77} and rows
            assert None in {r["doc_id"] for r in rows}
        assert sum(r["length"] for r in p.packing(spark, docs, SF).collect()) == sum(len(token_ids(t, encoder())) for t in texts)
