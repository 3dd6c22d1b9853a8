import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus import ODD, frame, texts
from tokenizers import Tokenizer

from specloom.llm import lengths, repair
from specloom.llm.tokens import Encoder, definition

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


STRANGE = ["", None, " a  b", "x \n y", "hi <|endoftext|> there", "trail ", "don't  ", "  z", "é à\xa0 ü", "a\tb c\n\nd", "q　 r s", "end\n", "   x", "it's we'll 'd 12 3a", "\x1c \x85 b", "日本 語 text", "a" * 5000]


def test_encoder_equals_the_library(plain):
    e = Encoder(definition(PATH))
    for rows in (STRANGE, texts(5, 40), STRANGE, [], [None]):
        ids, counts = e.encode(pa.array(rows, pa.string()))
        want = [plain(x) for x in rows]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_encoder_with_a_small_cache(plain):
    e = Encoder(definition(PATH), cache=50)
    rows = texts(6, 40)
    for r in rows:
        assert e.encode(pa.array([r]))[0].tolist() == plain(r)


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(0)
    ids = r.integers(0, 12, 20_000).astype(np.uint32)
    ids[5000:6000] = 3
    ends = np.append(np.sort(r.choice(np.arange(1, 19_999), 30, replace=False)), 20_000)
    symbols, cut, rules, sizes = repair.compress(ids, ends, 12, rounds=8, per_round=16)
    assert len(symbols) < 0.7 * len(ids)
    assert repair.expand(symbols, 12, rules).tolist() == ids.tolist()
    assert repair.expand(symbols, 12, rules, sizes).tolist() == ids.tolist()
    assert all(len(repair.expand(np.array([12 + i]), 12, rules)) == n for i, n in enumerate(sizes.tolist()))
    for a, b, x, y in zip(np.append(0, cut), cut, np.append(0, ends), ends):  # no symbol spans two documents
        assert repair.expand(symbols[a:b], 12, rules).tolist() == ids[x:y].tolist()


@pytest.mark.parametrize("per_round", [2048, 7])
def test_grammar_goes_on_until_no_pair_is_frequent(per_round):
    r = np.random.default_rng(1)
    passage = r.integers(0, 900, 400)
    parts = [p for _ in range(60) for p in (passage, r.integers(0, 900, 30), np.full(int(r.integers(1, 90)), 5), r.integers(0, 12, 50))]
    ids, ends = np.concatenate(parts).astype(np.uint32), np.cumsum([sum(map(len, parts[i : i + 8])) for i in range(0, len(parts), 8)])
    symbols, cut, rules, sizes = repair.compress(ids, ends, 900, per_round=per_round)
    assert repair.expand(symbols, 900, rules).tolist() == repair.expand(symbols, 900, rules, sizes).tolist() == ids.tolist()
    for a, b, x, y in zip(np.append(0, cut), cut, np.append(0, ends), ends):
        assert repair.expand(symbols[a:b], 900, rules).tolist() == ids[x:y].tolist()
    pairs = [p for a, b in zip(np.append(0, cut), cut) for p in zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist())]
    assert max(pairs.count(p) for p in set(pairs)) < 24
    assert sizes.max() >= 400  # the whole passage is one symbol


def test_shards_read_back(spark, plain):
    rows = [(i * 7 % 150, t) for i, t in enumerate(texts(9, 150) + ODD)] + [(None, "null id"), (None, "null id"), (3, "again")]
    shards = repair.write_shards(frame(spark, rows), definition(PATH), shard_ids=2000)
    assert shards.count() > 3
    got = sorted(repair.read_documents(shards, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    want = sorted((str(i), tuple([*plain(t), 0])) for i, t in rows)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        raw = np.array(r.ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(raw))
        at += len(r.ids)
    row = shards.first().asDict()
    first = repair.decode_range(row, 1)
    assert repair.decode_range(row, 1, 2, 9).tolist() == first[2:9].tolist()
    assert repair.decode_range(row, 1, 5, 5).tolist() == []


def test_no_documents(spark):
    shards = repair.write_shards(frame(spark, []), definition(PATH))
    assert shards.count() == 0 and repair.read_documents(shards).count() == 0
    assert lengths.histogram(lengths.token_lengths(frame(spark, []), definition(PATH))).count() == 0


def test_length_histogram(spark, plain):
    rows = list(enumerate(texts(10, 120) + ODD))
    h = lengths.histogram(lengths.token_lengths(frame(spark, rows), definition(PATH)), bucket=16)
    sizes = np.array([len(plain(t)) for _, t in rows])
    got = {r.length: r for r in h.collect()}
    assert sorted(got) == sorted(set(sizes.tolist()))
    for n, r in got.items():
        assert r.n_docs == (sizes == n).sum() and r.n_tokens == n * r.n_docs
        assert r.docs_at_least == (sizes >= n).sum() and r.tokens_at_least == sizes[sizes >= n].sum()
        assert r.truncated_total == np.minimum(sizes, n).sum()
        assert r.quantile == pytest.approx((sizes <= n).mean())
        assert (r.total_docs, r.total_tokens) == (len(sizes), sizes.sum())
    for r in lengths.at_limits(h, [0, 7, 100, 10**6]).collect():
        assert (r.docs_over, r.truncated_total, r.dropped_tokens) == ((sizes > r.limit).sum(), np.minimum(sizes, r.limit).sum(), (sizes - np.minimum(sizes, r.limit)).sum())
    assert lengths.quantile_length(h, 0.5).first().length == np.sort(sizes)[-(-len(sizes) // 2) - 1]


def test_vocabulary_is_not_in_the_repository():
    assert json.loads(definition(PATH))["model"]["type"] == "BPE"
