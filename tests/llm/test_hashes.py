"""Hashes of words and windows: patterned words that polynomials modulo 2**64 can't part, and pieces whose hashes clash."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from officium.llm import class_lm, common, content_store, line_crf, near_dedup, packing, substring_dedup, tokens


def morse(n):
    """The word of Thue and Morse over a and b, and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


ONE, OTHER = morse(1024)
LONG, LONG_OTHER = morse(4096)


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def crc(name, text, end):
    ids = Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids + [end]
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_equal_runs_and_only_they_are_equal():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abé"), rng.integers(1, 30))) for _ in range(4000)] + [ONE, OTHER, LONG, LONG_OTHER, "a", "a\0", "a" * 8, "a" * 9]
    t = next(common.slices(pa.array([" ".join(words), "", " ".join(words[::-1])])))
    w = common.words_of(t)
    h = common.run_hashes(t.data, w.starts, w.ends)
    spelled = [t.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    assert len(set(zip(spelled, h.tolist()))) == len(set(spelled)) == len(set(h.tolist()))
    for k in (1, 2, 3, 5, 8, 35):
        windows = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
        g = common.window_hashes(h, k).tolist()
        assert len(set(zip(windows, g))) == len(set(windows)) == len(set(g))


def test_store_keeps_the_ids_of_patterned_words(spark):
    folder = common.new_folder(spark, "morse")
    content_store.write_store(table(spark, ONE, OTHER, LONG, LONG_OTHER), folder, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in content_store.read_store(spark, folder).collect()}
    assert got == {i: crc("byte_bpe_50k.json", x, 0) for i, x in enumerate((ONE, OTHER, LONG, LONG_OTHER))}


def test_packing_keeps_the_ids_of_patterned_words(spark):
    rows = packing.pack(table(spark, ONE, OTHER, LONG, LONG_OTHER), public_tokenizers.path("word_bpe_49k.json"), length=1 << 14).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in rows if r["length"] == r["doc_tokens"]} == {i: crc("word_bpe_49k.json", x, 1) for i, x in enumerate((ONE, OTHER, LONG, LONG_OTHER))}


@pytest.mark.parametrize("name, keeps_space, end", [("byte_bpe_50k.json", True, 0), ("word_bpe_49k.json", False, 1)])
def test_pieces_are_told_apart_by_their_bytes(monkeypatch, name, keeps_space, end):
    """With hashes of five bits nearly every piece clashes with others, within a slice and with those kept before."""
    real = tokens.chunked_hashes
    monkeypatch.setattr(tokens, "chunked_hashes", lambda chunks, size: real(chunks, size) & common.U64(31))
    made = tokens.PieceEncoder(public_tokenizers.path(name), keeps_space, slots=64, kept_ids=300)
    rng = np.random.default_rng(2)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(rng.integers(0, 40))) for _ in range(10)]
        for t in common.slices(pa.array(texts)):
            ids, first = made.encode(t, end)
            assert [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first[:-1], first[1:])] == [crc(name, x, end) for x in texts]


def test_patterned_words_are_no_near_copies(spark):
    rows = near_dedup.near_dedup(table(spark, f"{ONE} {ONE}", f"{OTHER} {OTHER}", LONG, LONG_OTHER), words=2).collect()
    assert all(r["component_id"] == r["doc_id"] for r in rows)


def test_patterned_lines_are_no_copies(spark):
    t = next(common.slices(pa.array([f"{ONE}\n{OTHER}\n{LONG}\n{LONG_OTHER}\n{ONE}"])))
    assert line_crf.measured(t)[0]["n_dup_lines"].tolist() == [1]


def test_patterned_words_are_words_of_their_own_to_the_model(spark):
    train, held = next(i for i in range(99) if not class_lm.held_out(i)), next(i for i in range(99) if class_lm.held_out(i))
    docs = spark.createDataFrame([(train, ONE), (held, OTHER)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in class_lm.score(docs).collect()} == {train: 2, held: 1}


def test_patterned_words_make_no_repeated_passage(spark):
    texts = [" ".join([f"w{i}" for i in range(34)] + [x]) for x in (ONE, OTHER)]
    for r in substring_dedup.remove_repeats(table(spark, *texts)).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (35, 0, hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
