"""Line dedup on one text with very many lines that loses lines throughout, and on bitmaps with gaps."""

import time

from foretable.llm.line_dedup import apply_bitmaps, line_bitmaps, line_dedup

SCHEMA = "doc_id long, text string"


def test_gaps_between_words_of_a_bitmap(spark):
    own = [f"a line of its own, number {i}" for i in range(1000)]
    shared = {3: "shared line one", 64 * 5: "shared line two", 64 * 5 + 63: "shared line three", 64 * 9 + 1: "shared line four"}
    text = [shared.get(i, line) for i, line in enumerate(own)]
    docs = spark.createDataFrame([(1, "\n".join(shared.values())), (2, "\n".join(text))], SCHEMA)
    marks = {r.id: [x.word for x in r.kept] for r in line_bitmaps(docs).collect()}
    assert marks == {2: [0, 5, 9]}
    out = apply_bitmaps(docs, line_bitmaps(docs)).where("doc_id = 2").first()
    assert (out.n_lines, out.n_dropped, out.kept_text) == (1000, 4, "\n".join(line for i, line in enumerate(own) if i not in shared))


def test_seconds_grow_with_the_lines(spark):
    took = []
    for n in (20_000, 40_000, 160_000):
        lines = [f"this is line number {i}" for i in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(lines[::2])), (2, "\n".join(lines))], SCHEMA)
        began = time.time()
        row = line_dedup(docs).where("doc_id = 2").first()
        took.append(time.time() - began)
        assert (row.n_lines, row.n_dropped, row.kept_text) == (n, n // 2, "\n".join(lines[1::2]))
    assert took[2] < 5 * took[1] + 5  # four times the lines; a search of the bitmap for each line would take sixteen times as long
