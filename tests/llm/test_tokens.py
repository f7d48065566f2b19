"""Token counts and packing against the tokenizer library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterledger.llm import packing, token_counts, tokens

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", None, " ", "a", "a\x1cb !\x1c!", "x<|endoftext|> b  c", "a \n\n b\t\tc  d", "  lead", "trail  ", "é ́x", "ΑΣ ΑΣ. İ", "don't 'll  's", "wort x y\u0085z", "long " * 9000, "x" * 5000, "a", "a"]


@pytest.mark.parametrize(("path", "keep"), [(BYTE, True), (WORD, False)])
@given(st.lists(st.text(st.sampled_from(list("ab'Éß1 .\n\t\x1c\x85  ​!<|>s")), max_size=25), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(path, keep, batch):
    enc = tokens.encoder(path, keep)
    ids, bounds = enc.encode(batch)
    for k, text in enumerate(batch):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.counts(batch).tolist() == np.diff(bounds).tolist()


def test_cache_beyond_its_bound():
    enc = tokens.Encoder(WORD, False, most_cached=2)
    for text in ("one two three four", "five one", "two six"):
        assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_counts(docs_of):
    got = {r["id"]: r for r in token_counts.token_counts(docs_of(ODD), BYTE).collect()}
    library = Tokenizer.from_file(BYTE)
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs_of([]), BYTE).count() == 0


def test_packing_round_trip(docs_of, rng):
    texts = ODD + [" ".join(rng.choices(["alpha", "be", "gamma7"], k=rng.randint(1, 900))) for _ in range(150)]
    rows = packing.pack(docs_of(texts), WORD, capacity=256).collect()
    library, found, bins = Tokenizer.from_file(WORD), defaultdict(dict), defaultdict(list)
    for r in rows:
        found[r["id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert sorted(found[i]) == list(range(-(-len(ids) // 256)))
        for k, r in found[i].items():
            own = ids[k * 256 : (k + 1) * 256]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * 256, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 256
    assert len(bins) <= sum(r["length"] for r in rows) / 256 * 1.02  # bound of the measured slack on few pieces
    assert packing.pack(docs_of([]), WORD).count() == 0


@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 40))
@settings(deadline=None)
def test_fullest_is_the_best_subset(lengths, room):
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach if r + x <= room}
    chosen = packing.fullest(dict(Counter(lengths)), room)
    assert sum(chosen) == max(reach) and not Counter(chosen) - Counter(lengths)


def test_plan_with_a_hot_length():
    slots, n = packing.plan({600: 100_000, 848: 30_000, 5: 7, 2048: 3}, 2048)
    assert sum(times for *_, times, _, _ in slots) == 130_010
    assert n <= (600 * 100_000 + 848 * 30_000 + 35 + 3 * 2048) // 2048 + 12_000
