"""URL rules against brute force, registered queries against their SQL, the pipeline."""

import re

import pytest
from compare import compare
from conftest import SMALL
from pyspark.sql import functions as F

from ebbline.llm import queries, url_rules

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES.get(name), SMALL) == ""


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "http://a.example.net/en/1",
    "http://example.net/EN/", "http://example.com/de/?q", "http://b.example.com/de#x", "http://q.org/fr/", "http://q.org?/fr/",
    "http://a.com/http://b.net/", "http://spam-farm.example.com/en/", "http://xspam-farm.com/", "http://spam-farmx.com/",
    "http://spam-farm", "ftp://u@a.net:80/", "http://É.net/ü?z", "http://a.net/" + "p/" * 5000, "http://.net/", "x://a.net/\nb?c", "http://a.org/fr/x",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = re.split(r"[?#]", rest[cut:])[0] if rest[cut:cut + 1] == "/" else ""
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    bad = any(re.search(rf"(^|[^a-z0-9]){r.name.split(':')[1]}([^a-z0-9]|$)", host) for r in queries.HOST_PATTERNS)
    return host, path, None, "block" if bad else "allow"


def test_urls_against_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[3:5])] + [(None, URLS[6], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, Verdict string")
    got = url_rules.judge_urls(pages, [*queries.LIST_RULES, *queries.HOST_PATTERNS])
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "listed", "rules_run"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        rule = r["rule"] if r["listed"] else None
        assert (r["host"], r["path"], rule, r["verdict"]) == brute(r["url"]), r["url"]
    assert url_rules.judge_urls(pages.limit(0), queries.LIST_RULES).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, []).collect()} == {"allow"}


def test_only_rules_of_rare_tokens_run(spark):
    pages = spark.createDataFrame([(i, f"http://host{i}.example.com/de/{i}") for i in range(50)], "page_id long, url string")
    rules = [
        url_rules.host_rule("example.com", "/de/", "block"), url_rules.host_rule("host7.example.com", "/", "allow"),
        url_rules.UrlRule("no token", "block", "9$", (), 2, 1, False),
    ]
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, rules).collect()}
    assert got[7]["rule"] == "host7.example.com/" and got[7]["rules_run"] == 3
    assert got[8]["rules_run"] == 2 and got[8]["rule"] == "example.com/de/"
    assert got[19]["rule"] == "no token"


def test_ties_between_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    rules = [url_rules.UrlRule(n, v, "a", ("a",), 0, 1, True) for n, v in [("z", "allow"), ("y", "block"), ("x", "block")]]
    assert url_rules.judge_urls(pages, rules).first()["rule"] == "x"


def test_native_plan(spark):
    plan = queries.op7_url_filters(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
    assert "html" not in re.search(r"ReadSchema: \S+", plan)[0]


# ── pipeline ─────────────────────────────────────────────────────────────────

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    from ebbline.llm import contamination, covering_simhash, language_id, packing, toxicity
    from ebbline.llm.queries import fitted_language_reader, fitted_toxicity, packing_tokenizer

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"]: r for r in docs.collect()}
    frame = docs
    model, reader = fitted_toxicity(spark, SMALL), fitted_language_reader(spark, SMALL)
    finder = toxicity.HitFinder(model.terms, model.fuzzy_from)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    import numpy as np
    import pyarrow as pa

    for number, (name, step) in enumerate(pipeline.STAGES):
        step(spark, frame, SMALL).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        raw = {i: (r["text"] or "").encode() for i, r in kept.items()}
        if name == "toxicity":
            kept = {i: r for i, r in kept.items() if model.score(np.array([finder.features(raw[i])]))[0] < 0.5}
        elif name == "language_id":
            odds = {i: reader.documents(pa.array([raw[i]], type=pa.binary()))[0].max() for i in kept}
            kept = {i: r for i, r in kept.items() if re.search(r"[^\W\d_]", r["text"] or "") and odds[i] >= 0.5}
        elif name == "near_dedup":
            from test_pairs import brute_components

            root = brute_components({i: covering_simhash.fingerprint(raw[i]) for i in kept})
            kept = {i: r for i, r in kept.items() if root[i] == i}
        elif name == "decontamination":
            def bad(r):
                e = contamination.reference_hits(r["text"], items)
                return e["n_hit"] > 0 and 20 * e["n_hit"] >= e["n_words"]

            kept = {i: r for i, r in kept.items() if not bad(r)}
        if number < 4:
            assert frame.columns == docs.columns
            got = {r["doc_id"]: r for r in frame.collect()}
            assert got == kept, name
    words = packing.WordTokenizer(packing_tokenizer())
    lengths = {r["doc_id"]: r["doc_tokens"] for r in frame.collect()}
    assert lengths == {i: len(words.encode(r["text"] or "")) // 4 + 1 for i, r in kept.items()}
    assert frame.agg(F.sum("length")).first()[0] == sum(lengths.values())
    assert pipeline.run(spark, SMALL).count() == frame.count()
