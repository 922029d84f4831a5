from helpers import SCHEMA, row, words
from lingua_spark.llm import line_dedup


def test_short_lines(spark):
    """Lines of one to four words count as their whole word sequence; only lines without words stay."""
    texts = ["Read more\nHome\na b c d\n\nplain text of more than five words", "read  MORE\n home\nb a c d\n \na b c", None, "Home\nRead more now\na b c d\na b c\n",
             "HOME", "Home a b c d\nplain text of more than five words", "Été\nété", "été\nx"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)] + [row(None, "Home\nx")], SCHEMA).repartition(3)
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(words(line))
            if w and w in seen:
                want.add((i, k))
            seen.add(w)
    assert {(1, 0), (1, 1), (3, 0), (3, 2), (3, 3), (4, 0), (5, 1), (7, 0)} == want
    assert {(r["doc"], r["line"]) for r in line_dedup.later_matches(docs).collect()} == want
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_later_lines(docs.where("doc_id is not null")).collect()}
    assert left[3] == "Read more now\n" and 4 not in left and left[7] == "x"
