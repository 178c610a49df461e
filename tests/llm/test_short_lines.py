import corpus_pipeline
from siltstone.llm import line_dedup


def test_stage_drops_short_recurring_lines(spark):
    rows = [(i, f"line number {'abcdef'[i]} of its own\nAll rights  reserved.\n版权所有\n{i}\n\n", "en", "s", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = {r["doc_id"]: r["text"].split("\n")[1:] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got[0] == ["All rights  reserved.", "版权所有", "0", "", ""]
    assert all(got[i] == [str(i), "", ""] for i in range(1, 5) if i in got and len(got[i]) == 3) and all("版权所有" not in got[i] for i in range(1, 5))
    # Alone in its document, a number is no template.
    assert all(str(i) in "\n".join(got[i]) for i in range(5))
    assert line_dedup.dedup_lines(docs).where("text like '%reserved%'").count() == 5
