"""The registered queries themselves on the smallest tables: columns and types of the contract, rows, SQL, brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from retrace.llm import queries
from test_divergence_draw_index import drawn

FOLDER = "/root/testdata/sf0.001"
PER_DOCUMENT = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_ppm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op10_boosted_trees": "doc_id bigint, held_out boolean, score double, predicted int",
    "op12_importance": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}
OTHERS = {
    "op3_mixing": "doc_id bigint, source string, slot bigint",
    "op4_decontaminate": "doc_id bigint",
    "op6_chat_pairs": "pair_id bigint, chosen_id bigint, rejected_id bigint",
    "op7_substring_dedup": "doc_id bigint",
    "op11_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_permutation_index": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    return {}


def rows_of(spark, results, name):
    if name not in results:
        df = queries.QUERIES[name](spark, FOLDER)
        results[name] = df.dtypes, [r.asDict() for r in df.collect()]
    return results[name]


def test_every_operator_is_registered():
    assert set(queries.QUERIES) == {*PER_DOCUMENT, *OTHERS}


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHERS])
def test_contract(spark, duck, results, name):
    types, rows = rows_of(spark, results, name)
    wanted = [tuple(c.split(" ")) for c in (PER_DOCUMENT | OTHERS)[name].split(", ")]
    assert set(wanted) <= set(types)
    if name in PER_DOCUMENT:
        assert sorted(r["doc_id"] for r in rows) == [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    if name in queries.SQL:
        cursor = duck.execute(queries.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(c for c, _ in types)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, cursor.fetchall()))


def test_token_files_hold_what_the_library_encodes(spark, duck, results):
    tokenizer, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    found = {r["doc_id"]: r for r in rows_of(spark, results, "op2_token_files")[1]}
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        row = found[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_importance_draw_equals_brute_force(spark, duck, results):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    target = [r[0] for r in duck.execute("SELECT text FROM benchmark").fetchall()]
    want = sorted([(r[0], *r[2:]) for r in drawn(docs, target, 5)], key=repr)
    assert sorted([tuple(r.values()) for r in rows_of(spark, results, "op12_importance")[1]], key=repr) == want


def test_nearest_vectors_are_nearly_all_found(spark, duck, results):
    table = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], dtype=float)
    found, hits = {}, 0
    for r in rows_of(spark, results, "op13_permutation_index")[1]:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = ids[ids % 20 == 0]
    for q in asked:
        score = (x * x[ids == q]).sum(axis=1)
        score[ids == q] = -np.inf
        hits += len(found[q] & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hits >= 0.9 * 20 * len(asked)


def test_pipeline_keeps_only_what_its_stages_keep(spark, results):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER).orderBy("start").collect()
    ids = [r["doc_id"] for r in out]
    assert out and len(ids) == len(set(ids))
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:i]) for i in range(len(out))]
    kept = {r["doc_id"] for r in rows_of(spark, results, "op1_quality_rules")[1] if r["kept"]}
    assert set(ids) <= kept
    groups = {}
    for r in rows_of(spark, results, "op8_simhash")[1]:
        groups.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for group in groups.values():  # of equal texts one stays at most
        left = [texts[i] for i in group & set(ids)]
        assert len(left) == len(set(left))
