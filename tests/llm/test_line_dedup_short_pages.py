import corpus_pipeline
from leadlens.llm import line_dedup as L

SHARED = ["A line that stands on every one of the sites", "Another long line on every one of the sites"]


def pages():
    """A page of each site with two shared lines, then short pages with little or nothing of their own."""
    rows = [(i, "\n".join([f"text of page {i}, longer than the lines that it shares with others " * 3, *SHARED]), f"s{i}")
            for i in range(12)]
    return rows + [(50, f"{SHARED[0]}\nown\n\n{SHARED[1]}", "s1"), (51, "\n".join(SHARED), "s2"),
                   (52, f"\n{SHARED[1]}\n\n{SHARED[1]}", "s3"), (53, "\n", "s4"), (None, f"x\n{SHARED[0]}", "s5"),
                   (54, f"{SHARED[0]}\n ", "s6")]


def frame(spark):
    return spark.createDataFrame([(i, t, "en", s, 7) for i, t, s in pages()],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_the_stage_takes_shared_lines_from_short_pages(spark):
    got = {r.doc_id: r for r in corpus_pipeline.boilerplate_lines(spark, frame(spark), "").collect()}
    was = {i: t for i, t, _ in pages()}
    assert set(got) == set(was)
    assert got[0].text == was[0]  # the first document of both lines
    assert all(got[i].text == was[i].split("\n")[0] for i in range(1, 12))
    assert got[50].text == "own\n" and got[50].n_chars == 4  # nine tenths of it were shared
    assert got[None].text == "x" and got[54].text == " "
    assert all(got[i].text == was[i] and got[i].n_chars == 7 for i in (51, 52, 53))  # nothing of their own


def test_counts_of_lines(spark):
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in
           L.remove_boilerplate(frame(spark)).collect()}
    assert (got[0], got[1], got[50], got[51], got[52]) == ((3, 0), (3, 2), (4, 2), (2, 0), (4, 0))
