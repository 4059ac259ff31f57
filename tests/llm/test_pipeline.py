"""The corpus pipeline against a plain version of its stages."""

import corpus_pipeline
from papertide.llm import quality
from papertide.llm.shared import stored

from . import brute
from .test_native_operators import check_mix


def fixture_rows(rows):
    secret = "password=hunter2hunter2 " + " ".join(f"s{k}" for k in range(80))
    leaked = " ".join(f"b{k}" for k in range(100))
    out = [r[:5] for r in rows if r[0] is not None]
    out = list({r[0]: r for r in out}.values())
    return [*out, (50, secret, "en", "a", len(secret)), (51, leaked, "de", "b", len(leaked))]


def test_stages(spark, rows, tmp_path):
    from .test_similar import survivors  # which takes its documents from this module

    data = fixture_rows(rows)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, " ".join(f"b{k}" for k in range(10, 30)))]
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    d, kept, text = f"file://{tmp_path}", [r[0] for r in data], {r[0]: r[1] for r in data}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    out = stored(corpus_pipeline.STAGES[0][1](spark, docs, d))
    ok = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    kept = [i for i in kept if i in ok]
    assert ids(out) == sorted(kept) and out.columns == docs.columns and 7 not in kept

    out = stored(corpus_pipeline.STAGES[1][1](spark, out, d))
    kept = survivors([(i, text[i], None) for i in kept])
    assert ids(out) == kept and out.columns == docs.columns and 1 not in kept

    out = stored(corpus_pipeline.STAGES[2][1](spark, out, d))
    kept = [x[0] for x in brute.decontaminate([(i, text[i]) for i in kept], items) if not x[-1]]
    assert ids(out) == sorted(kept) and out.columns == docs.columns and 51 not in kept

    out = stored(corpus_pipeline.STAGES[3][1](spark, out, d))
    got = {r.doc_id: r.text for r in out.collect()}
    assert sorted(got) == sorted(kept) and got[50].startswith("[SECRET] s0 ") and out.columns == docs.columns
    assert all(got[i] == text[i] for i in kept if i != 50)

    mixed = [(r.doc_id, r.text, r.lang, r.source) for r in out.collect()]
    final = corpus_pipeline.STAGES[4][1](spark, out, d).collect()
    check_mix(mixed, final)
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, d).collect()) == sorted((r.doc_id, r.taken) for r in final)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
