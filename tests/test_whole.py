"""Queries that read whole tables, against brute force where the SQL is cut."""

import re

from siteglass.operators import keywords
from siteglass.plans import model as m
from siteglass.plans import registry, relational, texts

SF_DIR = "/root/testdata/sf0.001"


def test_word_counts_read_long_documents(spark, tmp_path):
    rows = [(1, "a", "rare word " + "filler " * 400, 2810), (2, "a", "Rare words", 10), (3, "a", "rare filler", None), (4, "b", "rare", 4)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.word): r.df for r in registry.queries()["kw_df"](spark, str(tmp_path)).collect()}
    held = {}
    for doc_id, source, text, _ in rows:
        for w in re.findall("[a-z0-9]+", text.lower()):
            held.setdefault((source, w), set()).add(doc_id)
    assert got == {k: len(v) for k, v in held.items() if len(v) > 1} == {("a", "rare"): 3, ("a", "filler"): 2}


def test_users_with_a_job_due_in_any_run(spark):
    clients = m.clients(spark, SF_DIR).select("client_id", "user_id").collect()
    due = {r.client_id for r in relational.jobs(spark, SF_DIR).where(relational.due(relational.NOW)).select("client_id").collect()}
    users = {r.user_id for r in clients if r.client_id in due}
    got = registry.queries()["join_semi_in_subquery"](spark, SF_DIR).collect()
    assert sorted((r.client_id, r.user_id) for r in got) == sorted((r.client_id, r.user_id) for r in clients if r.user_id in users)
    assert due and len(got) > 0


def test_catalogue_order_of_all_current_pages(spark):
    pages = m.current_pages(spark, SF_DIR).collect()
    want = sorted(pages, key=lambda r: (m.SEVERITIES.index(r.severity), r.page_id))
    got = registry.queries()["sort_catalogue"](spark, SF_DIR).collect()
    assert [(r.page_id, r.severity, r.place) for r in got] == [(r.page_id, r.severity, r.place) for r in want] and len(got) > 100


def test_outbound_links_within_the_budget(spark):
    own = {r.client_id for r in m.clients(spark, SF_DIR).collect()}
    first = {}
    for r in m.pages(spark, SF_DIR).collect():
        if r.code not in own:
            first[r.run_id, r.code] = min(r.place, first.get((r.run_id, r.code), r.place))
    runs = {}
    for (run, code), at in first.items():
        runs.setdefault(run, []).append((at, code))
    want = {(run, code, at) for run, links in runs.items() for at, code in sorted(links)[:300]}
    got = registry.queries()["outbound_plan"](spark, SF_DIR).collect()
    assert {(r.run_id, r.code, r.place) for r in got} == want and len(got) == len(want) > 0


def test_keywords_of_all_fields_and_lengths(spark, tmp_path):
    many = " ".join(f"alpha{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150))
    html = f"""<html lang="en"><head><title>Complete guide: Red kite</title><meta name="description" content="Gliding bird"></head>
    <body><main><h1>Red kite</h1><h2>Fork tail</h2><p>{many}</p><p>{many}</p></main></body></html>"""
    other = html.replace('lang="en"', 'lang="xx"')
    rows = [(1, "https://a.example/red-kite", html), (2, "https://b.example/red-kite", other)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    fields = texts.fields(spark, str(tmp_path))[0]
    held = {(r.field, r.text) for r in fields.where("page_id = 1").collect()}
    assert {("title", "Red kite"), ("titleTail", "Complete guide"), ("meta", "Gliding bird"), ("subheading", "Fork tail"), ("h1", "Red kite")} <= held
    found = registry.queries()["kw_collect"](spark, str(tmp_path)).groupBy("page_id").agg({"n_words": "max"}).collect()
    assert {r[0]: r[1] for r in found} == {1: 5, 2: 2}
    scored = registry.queries()["kw_page_score"](spark, str(tmp_path)).where("page_id = 1").collect()
    assert len(scored) > 600
    terms = spark.createDataFrame([(r.run, r.page_id, r.term, r.score) for r in scored], "run string, page_id long, term string, score double")
    value = {r.term: r.score for r in scored}
    lost = {s for s in value for t in value if 0 < len(t.split()) - len(s.split()) <= 2 and f" {s} " in f" {t} " and value[t] >= 0.5 * value[s]}
    assert {r.term for r in keywords.subsume(terms).collect()} == set(value) - lost
