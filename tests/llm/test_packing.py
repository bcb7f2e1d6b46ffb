import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspark.llm import packing
from reelspark.llm.queries import packed

FILE = public_tokenizers.path("byte_bpe_50k.json")


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_piece(counts):
    runs = packing.plan(dict(counts), 100, groups=8)
    held = Counter()
    for run in runs:
        assert run.copies > 0 and sum(run.lengths) <= 100
        for length in run.lengths:
            held[length] += run.copies
    assert held == Counter(counts)
    places = packing.Places(runs)
    seen = {}
    for length, n in counts.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            seen.setdefault(s, []).append((o, length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert len(seen) == places.sequences


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = Counter(rng.choice([rng.randint(1, 1024), 1024, rng.randint(200, 600)]) for _ in range(20_000))
    runs = packing.plan(counts)
    least = math.ceil(sum(k * n for k, n in counts.items()) / 1024)
    assert sum(r.copies for r in runs) <= 1.005 * least
    assert len(runs) < 5_000


def test_groups_hold_equally_many():
    groups = packing.groups_of({10: 5, 9: 1, 7: 6}, 3)
    assert [sum(n for _, n in g) for g in groups] == [4, 4, 4]
    assert groups == [[[10, 4]], [[10, 1], [9, 1], [7, 2]], [[7, 4]]]


@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=80))
@settings(max_examples=150, deadline=None)
def test_both_tokenizers_agree(text):
    encode = test_both_tokenizers_agree.encode
    assert encode(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


test_both_tokenizers_agree.encode = packing.Encoder(
    FILE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", "  x\r\n\ty  ", "it's WE'LL 12٣ €5", "\x85\xa0a"])
def test_special_texts(text):
    test_both_tokenizers_agree.hypothesis.inner_test(text)


def _check(rows, got):
    """Every document's ids come back from its pieces; sequences have no gaps."""
    slow = Tokenizer.from_file(FILE)
    want, have = Counter(), Counter()
    for key, text in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        head = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[key, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    sequences = {}
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_query(docs, odd, none):
    from conftest import ODD

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Ünter", "x1"], k=rng.choice([0, 3, 50, 900, 2500]))))
            for i in range(40)] + ODD
    _check(rows, packed(docs(rows).repartition(3)).collect())
    assert packed(none).count() == 0
