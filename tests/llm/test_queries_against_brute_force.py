"""Every query over the whole smallest table against a plain version."""

import hashlib
from collections import defaultdict

import brute
import pytest

pytest.importorskip("public_tokenizers")
from cohortlens.llm import queries as q  # noqa: E402


def by_id(spark, query, folder):
    found = query(spark, folder).collect()
    out = {r["doc_id"]: r.asDict() for r in found}
    assert len(out) == len(found)
    return out


def test_op1_ranks_held_out_toxic_documents_first(spark, real):
    got = by_id(spark, q.op1_toxicity, real[0])
    assert set(got) == {d for d, _, _ in real[1]}
    assert all(r["held_out"] == (brute.remainder(d, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())


def test_op2(spark, real):
    got = by_id(spark, q.op2_quality_rules, real[0])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {d: tuple(r[n] for n in names) for d, r in got.items()} == {d: brute.base_rules(t) for d, t, _ in real[1]}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())


def test_op3(spark, real):
    from tokenizers import Tokenizer

    got = by_id(spark, q.op3_token_files, real[0])
    expected = brute.token_rows([r[:2] for r in real[1]], Tokenizer.from_file(q.vocabulary(q.WORD_BPE)))
    assert [(d, got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) for d, *_ in expected] == expected


def test_op4(spark, real):
    got = by_id(spark, q.op4_simhash, real[0])
    ids = [d for d, _, _ in real[1]]
    prints = [brute.fingerprint(t) for _, t, _ in real[1]]
    assert [got[d]["fingerprint"] for d in ids] == [f"{f:016x}" for f in prints]
    assert [got[d]["component_id"] for d in ids] == brute.components(ids, prints)


def test_op5(spark, real):
    got = by_id(spark, q.op5_personal_data, real[0])
    for d, text, _ in real[1]:
        *base, joined = brute.base_pii(text)
        assert [got[d][n] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")] == base
        assert set(filter(None, joined.split(","))) <= set(got[d]["spans"].split(","))


def test_op6(spark, real):
    got, sizes, taken = by_id(spark, q.op6_mixing, real[0]), defaultdict(int), defaultdict(int)
    for d, text, source in real[1]:
        assert got[d]["size"] == len(brute.words(text)) and 0 <= got[d]["taken"] <= 3 * got[d]["size"]
        sizes[source] += got[d]["size"]
        taken[source] += got[d]["taken"]
    targets = brute.mix_targets(sizes)
    largest = max(r["size"] for r in got.values())
    for d, _, source in real[1]:
        assert got[d]["source_size"] == sizes[source] and got[d]["target"] == pytest.approx(targets[source])
        assert abs(taken[source] - targets[source]) <= largest
    assert by_id(spark, q.op6_mixing, real[0]) == got


def test_op7(spark, real):
    got = by_id(spark, q.op7_exact_dedup, real[0])
    expected = brute.exact_groups([r[:2] for r in real[1]])
    assert [tuple(got[d][n] for n in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for d, *_ in expected] == expected


def test_op8(spark, real):
    got = by_id(spark, q.op8_suffix_tree, real[0])
    for d, held_out, n_tokens, n_known, n, base in brute.base_scores([r[:2] for r in real[1]]):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out, n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base)
    held_out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_op9(spark, real):
    from tokenizers import Tokenizer

    tokenizer, got = Tokenizer.from_file(q.vocabulary(q.BYTE_BPE)), by_id(spark, q.op9_bpe, real[0])
    for d, text, _ in real[1]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10_keeps_trusted_text_and_rejects_most_other(spark, real):
    import pyarrow.parquet as pq

    got = by_id(spark, q.op10_quality_model, real[0])
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{real[0]}/labels.parquet").to_pylist()}
    assert set(got) == {d for d, _, _ in real[1]}
    assert all(got[d]["kept"] for d, good in labels.items() if good)
    assert sum(got[d]["kept"] for d, good in labels.items() if not good) <= 0.5 * sum(not g for g in labels.values())
