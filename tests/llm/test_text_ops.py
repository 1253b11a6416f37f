"""PII, BPE, quality rules and token files against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, pii, quality, tokenfile

DOCS = "doc_id long, text string, doc string, n_tokens string, score double"
ODD = [None, "", " ", "\n\n", "x", "a b", "é ü \x1c z", "naïve 🙂 text", "A" * 5000, "word " * 3000, "1" * 4000, "@" * 50, "+1 (972) 555-6416 a@b.co 10.0.0.1 4111 1111 1111 1111"]


def odd_docs(spark):
    rows = [(k, t, "clash", "clash", 0.5) for k, t in enumerate(ODD)] + [(3, "again", None, None, None), (None, "no id", None, None, None), (3, "again", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# ---------------------------------------------------------------- PII


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ@@.1204+- ()5é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_take_linear_time():
    for text in ("a" * 200_000 + "@", "1." * 100_000, "1" * 200_000, "+1" * 100_000, "a@" * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


@pytest.mark.parametrize("text,want", [
    ("mail bob dot smith at example dot com now", [("email", 5, 37)]),
    ("call (555) 123-4567 today", [("phone", 5, 19)]),
    ("host 192[.]168[.]1[.]20 is up", [("ip", 5, 23)]),
    ("pay 4111.1111.1111.1111 now", [("card", 4, 23)]),
    ("password=b7db7aa4a5fcc78305 ok", [("secret", 0, 27)]),
    ("in 2021-03-04 version 1.2.3 cost 123,456.78 at 10:20, look at the dot", []),
    ("", []),
])
def test_field_adds_spans(text, want):
    assert pii.find(text, pii.trained())[1] == want


def test_field_decodes_the_best_segmentation():
    """The dynamic program against all segmentations of a short text."""
    weights, text = pii.trained(), "a 555-123-4567 b@c.de 1.2.3.4"
    edges, ending = pii._candidates(text, 0, len(text))

    def best(j):
        if j == 0:
            return 0.0
        return max([best(j - 1)] + [best(i) + pii._score(weights, k, f) for i, f in ending.get(j, ()) for k in pii.KINDS])

    got = pii.decode(text, 0, len(text), weights)
    at = {e: k for k, e in enumerate(edges)}
    found = {(at[s], at[e]): k for k, s, e in got}
    assert sum(pii._score(weights, k, next(f for i, f in ending[j] if i == s)) for (s, j), k in found.items()) == pytest.approx(best(len(edges) - 1))


_PIECES = ["john", "a1", "12", "555", "4111", "1234567", "@", ".", "-", " ", "  ", "\n", " at ", " dot ", "[at]", "(at)", "[.]", "[dot]", "example", "com", "token=", "password: ", "ghp_abcdefghijklmnop", "x" * 30, "z " * 40, "=" * 50, "٣", "²", "é", '"', "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=40))
def test_field_sees_the_whole_text(pieces):
    """What the field finds in the neighbourhoods of its triggers is what it finds in the text as a whole."""
    text, weights = "".join(pieces), pii.trained()
    parts = [s for lo, hi in pii.islands(text) for s in pii.decode(text, lo, hi, weights)]
    assert parts == pii.decode(text, 0, len(text), weights)


def test_an_at_in_prose_is_no_address():
    assert pii.find("look at example.com or meet at noon.com", pii.trained())[1] == []


def test_field_on_held_out_sentences():
    rng, weights, right, said, real = random.Random(99), pii.trained(), 0, 0, 0
    for _ in range(200):
        text, spans = pii._synthetic(rng)
        got = set(pii.decode(text, 0, len(text), weights))
        right, said, real = right + len(got & set(spans)), said + len(got), real + len(spans)
    assert right / said > 0.9 and right / real > 0.9


def test_redaction(spark):
    out = {(r["doc_id"], r["text"]) for r in pii.redact(odd_docs(spark)).collect()}
    assert (12, "<PHONE> <EMAIL> <IP> <CARD>") in out and (0, None) in out
    assert pii.redact(odd_docs(spark)).columns == odd_docs(spark).columns
    assert pii.redact(odd_docs(spark).limit(0)).count() == 0


def test_op1(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            base = brute_spans(ODD[r["doc_id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            assert r["n_phone"] == sum(k == "phone" for k, _, _ in base)


def test_op1_and_op3_of_an_empty_table(spark, tmp_path):
    odd_docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op1_pii(spark, str(tmp_path)).count() == quality.op3_quality(spark, str(tmp_path)).count() == 0
    assert bpe.stage(spark, odd_docs(spark).limit(0), str(tmp_path)).columns == ["doc_id", "n_tokens", "ids"]
    assert bpe.stage(spark, odd_docs(spark).limit(0), str(tmp_path)).count() == 0 and pii.stage(spark, odd_docs(spark).limit(0), "").count() == 0


def test_op1_returns_the_spans_of_the_whole_text(spark, tmp_path):
    """The query's spans against the field over each whole text, without neighbourhoods."""
    rng, weights = random.Random(7), pii.trained()
    rows = [(k, " ".join(pii._synthetic(rng)[0] for _ in range(rng.randint(1, 4)))) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    for k, text in rows:
        base = brute_spans(text)
        more = [x for x in pii.decode(text, 0, len(text), weights) if x[0] == "secret" or not any(x[1] < e and s < x[2] for _, s, e in base)]
        want = sorted({*base, *more}, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))
        assert got[k] == ",".join(f"{a}:{b}:{c}" for a, b, c in want)


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def plain():
    path, pattern = bpe.default_vocabulary()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks, pattern


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab'sé \n\t  \x1c.,1", max_size=80), size=st.integers(1, 12))
def test_pieces_don_t_change_tokens(plain, text, size):
    pieces = bpe.pieces(text, size)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in plain[0].encode_ordinary(p)] == plain[0].encode_ordinary(text)


def test_codec(plain):
    codec = bpe.Codec(plain[1], plain[2])
    for text in (*ODD[1:], "x y " * 50_000, "日本語 テキスト"):
        ids = codec.encode(text)
        assert ids == plain[0].encode_ordinary(text) and codec.decode(ids) == text.encode()
    ids = codec.encode("日本")
    assert codec.decode(ids[:1]) == "日本".encode()[: len(codec.decode(ids[:1]))]  # a cut inside a character


def test_encode_and_decode_tables(spark, tmp_path):
    docs, args = odd_docs(spark), bpe.default_vocabulary()
    tokens = bpe.encode(docs, *args)
    back = sorted((r["id"] is None, r["id"] or 0, bytes(r["bytes"])) for r in bpe.decode(tokens, *args).collect())
    assert back == sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode()) for r in docs.collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op2_byte_bpe(spark, str(tmp_path)).collect()
    for r in rows:
        if r["doc_id"] not in (None, 3):
            assert r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), *args).count() == 0


# ---------------------------------------------------------------- quality


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = text.split("\n"), 0
    for k, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\t \x1cé|", max_size=70))
def test_counts(text):
    assert quality.counts(text) == brute_counts(text)


def test_viterbi_against_all_labellings():
    from itertools import product

    rng, weights = random.Random(1), quality.trained()
    for _ in range(20):
        facts = quality.sequence_facts(quality._made_up(rng)[0])[0][:7]
        rows = [quality._scores(weights, f) for f in facts]
        total = lambda ys: sum(r[y] for r, y in zip(rows, ys, strict=True)) + sum(weights.get(p, 0.0) for p in zip(ys, ys[1:], strict=False))  # noqa: B023, E731
        assert total(quality.viterbi(rows, weights)) == pytest.approx(max(map(total, product((0, 1), repeat=len(rows)))))


def test_lines_on_held_out_sequences():
    rng, weights, right, n = random.Random(77), quality.trained(), 0, 0
    for _ in range(200):
        lines, labels = quality._made_up(rng)
        got = quality.viterbi([quality._scores(weights, f) for f in quality.sequence_facts(lines)[0]], weights)
        right, n = right + sum(a == b for a, b in zip(got, labels, strict=True)), n + len(labels)
    assert right / n > 0.93


def test_op3_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97


def test_lines_count_the_words_that_n_words_counts():
    text = "one\x1ctwo three\u2003four\nfive"
    assert sum(quality.sequence_facts(text.split("\n"))[1]) == quality.counts(text)[0] == 3


def test_op3_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = quality.op3_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r["doc_id"] in (0, 1, 2, 5, 6):
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(ODD[r["doc_id"]] or "")
            assert r["base_failed"] and not r["kept"]


# ---------------------------------------------------------------- token files


@pytest.fixture(scope="module")
def words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    return tokenfile.WordEncoder(open(path, encoding="utf-8").read()), whole, open(path, encoding="utf-8").read()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB'stÉéßİΣﬁ \n\t \x1c.,12<|>endoftx́", max_size=60))
def test_word_encoder(words, text):
    assert words[0].encode(text.encode()) == np.array(words[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", ["a <|startoftext|> b", "<|endoftext|>", "x<|endoftext|>y é", "<|ENDOFTEXT|> a", "<|endoftext|><|startoftext|>"])
def test_added_tokens_are_the_library_s(words, text):
    assert words[0].encode(text.encode()) == np.array(words[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_vocabularies_are_the_library_s(words):
    import json

    from tokenizers import Tokenizer

    for change in ({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}):
        model = json.dumps(json.loads(words[2]) | change)
        whole, ours = Tokenizer.from_str(model), tokenfile.WordEncoder(model)
        for text in ("A Word's b1", "x,y\u2028z  É", ""):
            assert ours.encode(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_encoder_forgets(words, monkeypatch):
    monkeypatch.setattr(tokenfile, "MOST_WORDS", 5)
    encoder, rng = tokenfile.WordEncoder(words[2]), random.Random(2)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 20)))
        assert encoder.encode(text.encode()) == np.array(words[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 17, n).astype("<u4")
    planes = tokenfile.to_planes(ids, bits)
    assert (tokenfile.from_planes(planes, n) == ids).all() and planes[-1] == b""


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(tmp_path, bits, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    rng, docs = np.random.default_rng(0), []
    with open(tmp_path / "f", "wb") as out:
        w = tokenfile.Writer(out, bits)
        for k, n in enumerate((0, 1, 63, 64, 65, 500, 0, 3)):
            ids = rng.integers(0, 1 << 20, n).astype("<u4").tobytes()
            docs.append((None if k == 1 else -k, ids))
            w.add(*docs[-1])
        w.close()
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "f"))
    assert [(d, b"".join(p)) for d, p in tokenfile.read_docs(file)] == docs
    index = tokenfile.read_index(file)
    whole = b"".join(i for _, i in docs)
    assert tokenfile.read_block(file, index["blocks"][3]).tobytes() == whole[4 * 192 : 4 * 256]
    (tmp_path / "g").write_bytes(b"x" * 99)
    with pytest.raises(ValueError):
        tokenfile.read_index(fs.LocalFileSystem().open_input_file(str(tmp_path / "g")))


def test_op7(spark, words, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = tokenfile.op7_token_planes(spark, str(tmp_path)).orderBy("start").collect()
    assert len(rows) == len(ODD) + 3 and [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 3, 3, *range(4, len(ODD))]
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] not in (None, 3):
            ids = words[1].encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_op7_of_an_empty_table(spark, tmp_path):
    odd_docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert tokenfile.op7_token_planes(spark, str(tmp_path)).count() == 0
