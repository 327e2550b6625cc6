"""The registered training-data queries against their SQL or plain Python, on small tables."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as E
import brute
from check_oracle import rows_key, type_mismatches
from faultline.llm.queries import language_model

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark pages conversations labels embeddings".split()
ORACLES = E.oracle_sql()
LLM = [f"op{n}_" for n in range(1, 14)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def test_one_query_for_each_operator():
    assert [sum(q.startswith(x) for q in E.queries()) for x in LLM] == [1] * 13
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", [q for q in ORACLES if q.startswith(tuple(LLM))])
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    cols, types = [d[0] for d in cur.description], {d[0]: d[1] for d in cur.description}
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert type_mismatches({f.name: f.dataType.simpleString() for f in df.schema.fields}, types) == []
    assert rows_key(df.columns, rows, False) == rows_key(cols, want, False)


def test_language_id_on_held_out_documents(spark, docs):
    lang = {i: x for i, _, x in docs}
    rows = E.queries()["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_id_equals_plain_python(spark, docs):
    model = language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = {r.doc_id: r for r in E.queries()["op2_language_id"](spark, SF).collect()}
    for i, x, _ in docs:
        lang, share = brute.main_language(x, model)
        assert (rows[i].lang_pred, round(rows[i].score, 9)) == (lang, round(share, 9))


def test_pipeline_without_labels_keeps_texts_with_letters(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "text", None, "s", 4), (2, "1 2 3", None, "s", 5), (3, None, None, "s", 0), (4, "日本", None, "s", 2), (2, "\u0301", None, "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.language_id(spark, docs, SF).collect()) == [1, 4]


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in docs}
    rows = E.queries()["op3_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_bpe_equals_the_library(spark, docs):
    from faultline.llm.byte_bpe import TreeBpe

    lib = TreeBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).lib
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, x, _ in docs:
        ids = lib.encode_ordinary(x or "")
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((x or "").encode()))
    rows = E.queries()["op4_byte_bpe"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_line_dedup_equals_all_pairs(spark, docs):
    kept = brute.kept_lines([(i, x) for i, x, _ in docs])
    want = {i: None if x is None else "\n".join(s for k, s in enumerate(x.split("\n")) if kept.get((i, k), True)) for i, x, _ in docs}
    rows = E.queries()["op5_line_dedup"](spark, SF).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_dropped for r in rows) == sum(not k for k in kept.values()) > 0


def test_sharding_is_near_equal_gapless_and_keeps_texts_together(spark, docs):
    rows = E.queries()["op7_sharding"](spark, SF).collect()
    text = {i: x or "" for i, x, _ in docs}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    slots, sizes, homes = {}, {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    fair, largest = sum(sizes.values()) / 24, max(r.size for r in rows)
    assert all(abs(sizes.get(k, 0) - fair) <= 2 * largest for k in range(24))
    size = {t: len(t.encode()) + 8 for t in homes}
    assert all(len(h) == 1 for t, h in homes.items() if size[t] * list(text.values()).count(t) < fair / 64)


def test_near_dedup_equals_all_pairs(spark, docs):
    want = brute.near_components([(i, x) for i, x, _ in docs], 2, 80)
    rows = E.queries()["op9_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_pipeline_stages_keep_what_they_should(spark, docs):
    import corpus_pipeline as P

    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in P.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now, SF).schema)
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "byte_bpe":
            assert now.columns == columns
    text = {i: x for i, x, _ in docs}
    # language ID: texts without letters or without a main language go
    model = language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(seen["language_id"]) == {i for i, x in text.items() if brute.main_language(x, model)[1] >= P.MIN_SHARE}
    assert {i for i, x in text.items() if x and any(c.isalpha() for c in x)} >= set(seen["language_id"])
    assert len(seen["language_id"]) >= 0.97 * len(text)
    kept = brute.kept_lines([(i, r.text) for i, r in seen["language_id"].items()])
    want = {i: "\n".join(s for k, s in enumerate(r.text.split("\n")) if kept.get((i, k), True)) for i, r in seen["language_id"].items()}
    want = {i: x for i, x in want.items() if any(kept.get((i, k)) for k in range(len(seen["language_id"][i].text.split("\n"))))}
    assert {i: r.text for i, r in seen["line_dedup"].items()} == want
    near = brute.near_components(list(want.items()), 5, 80)
    assert set(seen["near_dedup"]) == {i for i, (_, c) in near.items() if i == c}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.ASCII_LOWER))
    windows = lambda w, n=10: {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()
    items = set().union(*[windows(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    sizes = {len(x) for x in items}
    clean = {i for i, r in seen["near_dedup"].items() if not any(windows(words(r.text), n) & items for n in sizes)}
    assert set(seen["decontamination"]) == clean < set(seen["near_dedup"])
    assert set(seen["byte_bpe"]) == set(seen["decontamination"])
    assert all(r.decoded_sha256 == hashlib.sha256(seen["decontamination"][i].text.encode()).hexdigest() for i, r in seen["byte_bpe"].items())
