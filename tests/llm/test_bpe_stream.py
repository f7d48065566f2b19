"""Streamed encoding and decoding against the tokenizer library, blocks of any size, sufficient lookahead on small merge lists."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterledger.llm import bpe_stream as B
from rasterledger.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MERGES, KINDS = B.MergeList(PATH), B.Kinds(PATH)
ODD = ["", None, " ", "a", "x<|endoftext|> b  c", "  <|endoftext|>", "<|endoftex", "a \n\n b\t\tc  d", "trail  ", "é ́x", "don't 'll  's '", "'r", "z\u0085 \x1c a ", "꟎꟏ ֋a 𐥀𐥁", "x" * 9000, " " * 9000, " " * 9000 + "a", "\n" * 5000 + "1", "1" * 5000 + "b", "<" * 4200 + "<|endoftext|>", "long " * 30000, "Ünï 🙂🙂" * 700, "a", "a"]


def _streamed(text, sizes):
    scanner, out, at = B.Scanner(MERGES, KINDS, {}), [], 0
    while at < len(text):
        n = sizes[len(out) % len(sizes)]
        out.append(scanner.feed(text[at : at + n]))
        at += n
    return np.frombuffer(b"".join([*out, scanner.finish()]), "<u4").tolist()


@given(st.lists(st.sampled_from([*"ab'rels Éß1.<|> \n\t\x1c\x85 ꟎🙂", "<|endoftext|>", "'ll"]), max_size=60).map("".join), st.lists(st.integers(1, 9), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_blocks_of_any_size_give_the_library_s_ids(text, sizes):
    assert _streamed(text, sizes) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_long_runs(text, monkeypatch):
    monkeypatch.setattr(B, "LONG", 40)
    assert _streamed(text, [7, 64, 1000]) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_a_window_is_all_that_is_held(rng):
    text = "".join(rng.choices(["amental", "Fund", "ing", "the", "x", "zz"], k=20_000))
    long, out, most = B.Transducer(MERGES), [], 0
    for i in range(0, len(text), 500):
        out += long.feed(text[i : i + 500].encode())
        most = max(most, len(long.window))
    assert most < 4 * MERGES.lookahead + 500
    assert [*out, *long.finish()] == LIBRARY.encode(text, add_special_tokens=False).ids


def _plain(rules, data):
    parts = [bytes([b]) for b in data]
    for u, v in rules:
        i, out = 0, []
        while i < len(parts):
            if parts[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_lookahead_suffices(data):
    tokens, rules = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(1, 7))):
        u, v = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if u + v not in tokens:
            rules.append((u, v))
            tokens.append(u + v)
    look = B.sufficient_lookahead(rules)
    head = bytes(data.draw(st.lists(st.sampled_from(b"abc"), max_size=14)))
    same = bytes(data.draw(st.lists(st.sampled_from(b"abc"), min_size=look, max_size=look)))
    ends = []
    for _ in range(2):
        parts = _plain(rules, head + same + bytes(data.draw(st.lists(st.sampled_from(b"abc"), max_size=12))))
        ends.append({e for e in np.cumsum([len(p) for p in parts]).tolist() if e <= len(head)})
    assert ends[0] == ends[1]


@given(st.lists(st.integers(0, 50256), max_size=40), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_decoding_any_ids(ids, step):
    text = B.Text(MERGES.bytes_of)
    got = "".join([*(text.feed(np.array(ids[i : i + step])) for i in range(0, len(ids), step)), text.finish()])
    assert got == LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_table(docs_of, spark, tmp_path):
    rows = {r["id"]: r for r in B.decode(B.encode(docs_of(ODD), PATH), PATH).collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == ids and rows[i]["n_tokens"] == len(ids) and rows[i]["text"] == (text or "")
    assert B.encode(docs_of([]), PATH).count() == 0
    docs_of(ODD).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op12_bpe_encoding_and_decoding"](spark, str(tmp_path)).collect():
        text = ODD[r["doc_id"]] or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (r["ids_sha256"], r["decoded_sha256"]) == (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
