"""Awkward rows through the queries themselves, and the quality stage against brute force where lines are boilerplate."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken
from data import TEXTS, docs, nulls, rows
from oracle import assert_same
from test_operators import brute_quality, quality_fixture

from incidara.llm import byte_bpe, queries, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(spark, path, **tables):
    """Tables as a data directory, and DuckDB with views of them."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return con


#: Every kind of white space between words and lines, where it makes a difference to counts.
SPACED = [
    (30, "a\rb\rc a\x0bb\x0cc"), (31, "\r\n one \r\n two\r"), (32, " ".join(["w"] * 199) + "\rw"), (33, "\r".join(f"x{k}" for k in range(200))),
    (34, "Ab\u00a0Cd\u2028e\x85f\x1cg"), (35, "<P>\nplain\n"), (36, "\n\n\n"), (37, "no end\r\nof line\r"),
]


def test_queries_equal_sql_on_any_white_space(spark, tmp_path):
    labels = spark.createDataFrame([(30, 1, 0), (32, 1, 1), (33, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    short = [(i, t) for i, t in TEXTS if i is not None and len(t or "") < 10_000]  # the SQL of operator 10 takes minutes for a longer one
    con = written(spark, tmp_path, documents=docs(spark, short + SPACED), labels=labels)
    for name in ("op1_exact_dedup", "op10_quality_rules", "op12_fill_in_middle", "op13_filter_audit"):
        assert_same(spark, con, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path))


def test_urls_of_awkward_rows(spark, tmp_path):
    urls = [(None, None), (None, "http://a.com/en/x"), (1, "http://casino.x/"), (1, "http://casino.x/"), (2, "x" * 300_000 + "://h/free?bonus"), (3, "://"), (4, "HTTP://A.NET/de/\n#"), (5, "a://B.org?/es/")]
    con = written(spark, tmp_path, pages=spark.createDataFrame([(i, u, "h", "p") for i, u in urls], "page_id long, url string, host string, path string"))
    assert_same(spark, con, queries.op5_url_filter, queries.oracle_sql()["op5_url_filter"], str(tmp_path))
    got = rows(url_filter.judge_urls(spark.read.parquet(f"{tmp_path}/pages.parquet"), queries.URL_RULES))
    assert len(got) == len(urls) and [r["verdict"] for r in got if r["page_id"] == 1] == ["block"] * 2


def test_byte_bpe_query_on_awkward_rows(spark, tmp_path):
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    table = docs(spark, TEXTS + SPACED).unionByName(nulls(spark))
    written(spark, tmp_path, documents=table)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def expected(text):
        ids = plain.encode_ordinary(text or "")
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())

    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(queries.op6_byte_bpe(spark, str(tmp_path)))), key=str)
    assert got == sorted(((r["doc_id"], *expected(r["text"])) for r in rows(table)), key=str)


def brute_boilerplate(table, most=20, left=25):
    """Boilerplate lines of each (host, text) that has some, and which of these texts are depleted; ``table`` has id, text and host."""
    copies = collections.Counter((h or "", t or "") for _, t, h in table)
    texts = {}
    for (host, text), n in copies.items():
        lines = [x for x in map(normal, text.split("\n")) if x]
        beside = ["", *lines, ""]
        texts[host, text] = {x: (k, (beside[k], beside[k + 2]), len(x.split(" ")) * lines.count(x) * n) for k, x in reversed(list(enumerate(lines)))}
    have, contexts, edges = (collections.defaultdict(set) for _ in range(3))
    for (host, text), lines in texts.items():
        for line, (_, context, _) in lines.items():
            have[host, line].add(text)
            contexts[host, line].add(context)
    over = {k for k, found in have.items() if len(found) > most}
    for (host, _), lines in texts.items():
        order = sorted(lines, key=lambda x: lines[x][0])
        own = [x for x in order if (host, x) not in over]
        if 100 * sum(lines[x][2] for x in own) >= left * sum(s for _, _, s in lines.values()):
            for x in order:
                before = [y for y in own if lines[y][0] < lines[x][0]]
                after = [y for y in own if lines[y][0] > lines[x][0]]
                edges[host, x].add((before[-1] if before else "", after[0] if after else ""))
    gone = {k for k in over if 2 * len(contexts[k]) >= len(have[k]) or 2 * len(edges[k]) >= len(have[k])}
    out = {}
    for (host, text), lines in texts.items():
        if found := {x for x in lines if (host, x) in gone}:
            whole = sum(s for _, _, s in lines.values())
            out[host, text] = found, 100 * (whole - sum(lines[x][2] for x in found)) < left * whole
    return out


def normal(line):
    return re.sub("[ \t\x0b\f\r]+", " ", line.translate(LOWER)).strip(" ")


def brute_clean(table):
    shared, out = brute_boilerplate(table), []
    for i, text, host in table:
        lines, depleted = shared.get((host or "", text or ""), (set(), False))
        if brute_quality(text)[0] < 10 or depleted:
            continue
        if lines:
            text = "\n".join(x for x in text.split("\n") if normal(x) not in lines)
        words, repeats = (brute_quality(text)[k] for k in (0, 4))
        if words >= 10 and 100 * repeats <= 20 * words:
            out.append((i, text))
    return out


def test_quality_stage_equals_brute_force_where_lines_are_boilerplate(spark):
    import corpus_pipeline

    table = quality_fixture() + [(i, t, "b") for i, t in SPACED]
    df = spark.createDataFrame(table, "doc_id long, text string, source string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars", "'en' AS lang")
    got = rows(corpus_pipeline.quality_rules(spark, df, ""))
    want = brute_clean(table)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    kept = dict(want)
    shorter = [i for i, t, _ in table if i in kept and kept[i] != t]
    assert len(shorter) >= 60 and not {200, 203, 204} & set(kept)  # lines go, and what is little else goes whole
