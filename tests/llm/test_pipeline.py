"""The pipeline's rows against each stage done by brute force, and its stages on odd rows."""

import corpus_pipeline
from test_models_and_packing import ODD, check_packed
from test_near_and_exact import UP, brute_components, brute_leaks

from kgspark.llm import language_id
from kgspark.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    judged = language_id.predict(language_id.fit(docs), [t for _, t in rows])
    rows = [r for r, lang, bits in zip(rows, judged["lang_pred"], judged["bits_per_byte"], strict=True) if lang != "und" and bits < 8]
    last = {}
    for i, t in rows:
        last[(t or "").translate(UP)] = max(i, last.get((t or "").translate(UP), i))
    rows = [(i, t) for i, t in rows if last[(t or "").translate(UP)] == i]
    low = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if low[i][1] == i]
    bad = {i for i, *_ in brute_leaks(rows, items)}
    rows = [(i, t) for i, t in rows if i not in bad]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    check_packed(got, rows)


def test_stages_take_odd_rows_and_keep_the_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en" if i else None, None, None) for i, t in [*ODD, (20, "the words of a text"), (21, "The words of a text")]]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.filter("doc_id = 21").count() == (0 if name == "ngram_join" else 1), name
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.columns == corpus_pipeline.COLUMNS and empty.count() == 0, name
    packed = corpus_pipeline.pack(spark, docs, FOLDER)
    assert packed.agg({"length": "sum"}).first()[0] > 0
