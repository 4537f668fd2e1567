"""Columns of any name are kept, and added ones replace those of the same name in any case."""

import corpus_pipeline
from tests.llm.helpers import AWKWARD
from tracelake.llm import html, langid, linededup, mixing, neardup, packing, quality, simhash, tokens, winnow

CLASH = ["a.b", "N_TOKENS", "_host", "_found", "_times", "_rest", "Text", "TH", "SCORE", "n_lines", "Group", "_0"]


def clashing(spark):
    """Documents with clashing names around the needed columns; the extra columns tell the row."""
    schema = ", ".join(f"`{c}` string" for c in CLASH[:6]) + ", doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH[6:])
    return spark.createDataFrame([(*(f"{c}{n}" for c in CLASH[:6]), i, t, lang, src, 1, *(f"{c}{n}" for c in CLASH[6:])) for n, (i, t, lang, src) in enumerate(AWKWARD)], schema)


def kept(df, added):
    """Checks names and the extra values of every row; the rows' numbers."""
    names = [c for c in clashing(df.sparkSession).columns if c.lower() not in {a.lower() for a in added}]
    assert df.columns == [*names, *added]
    at = [i for i, c in enumerate(df.columns) if c in CLASH and c not in added]
    found = []
    for r in df.collect():
        ends = {tuple(r)[i].removeprefix(df.columns[i]) for i in at}
        assert len(ends) == 1
        found.append(int(ends.pop()))
    return sorted(found)


def test_functions_that_add_columns(spark):
    table = clashing(spark)
    every = list(range(len(AWKWARD)))
    assert kept(tokens.with_token_counts(table), ["n_bytes", "n_tokens", "over_limit"]) == every
    model = langid.learn_languages(table)
    assert kept(langid.with_language(table, model), ["lang_pred", "score", "ambiguous"]) == every
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 11)], "doc_id long, quality int, toxic int, QUALITY string")
    assert kept(quality.with_quality(table, quality.learn_quality(table, labels)), ["score", "predicted"]) == every
    assert kept(linededup.dedup_lines(table), ["n_lines", "n_dropped"]) == every
    assert set(kept(mixing.mixed_documents(table), [])) <= set(every)
    pages = table.toDF(*["page_id" if c == "doc_id" else "url" if c == "source" else "html" if c == "text" else c for c in table.columns])
    out = html.main_text(pages)
    assert out.columns == [c for c in pages.columns if c not in ("Text", "n_chars")] + ["text", "n_chars"] and out.count() == len(AWKWARD)


def test_functions_with_columns_of_their_own(spark):
    table = clashing(spark)
    n, ids = len(AWKWARD), {i for i, *_ in AWKWARD}
    assert packing.pack(packing.pieces(table)).select("doc_id").distinct().count() == len(ids)
    assert winnow.compare_with_next(table).count() == n and simhash.near_duplicates(table).count() == n
    assert neardup.similar_documents(table).select("doc_id").distinct().count() >= len(ids) - 1


def test_stages_keep_columns(spark, sf):
    table = clashing(spark)
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        assert stage(spark, table, sf).columns == table.columns
        assert kept(stage(spark, table, sf), []) is not None
