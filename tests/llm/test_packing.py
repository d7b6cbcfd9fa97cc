import zlib

import numpy as np
from deckflow.llm import packing, tokens


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe())


def test_words_give_the_ids_of_the_whole_text():
    odd = [
        "Hello<|ENDOFTEXT|> x<|endoftext|>y ", "ΑΣ ΑΣ. İstanbul É é ́a a!\x1c!b", "it's IT'S They'LL don't 12a3 a-b",
        "ÀÉ*** Straße.!!a !! .. ...", "a b c\x0bd", "ªº ẞß", "don’t stop,, ok;;'s", "", "  ", None,
        "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(0x20, 0x250))),
    ]
    whole = tokenizer()
    for limit in (2, 1000):
        words = tokens.WordEncoder(tokens.word_bpe(), limit)
        for _ in range(2):
            for text, got in zip(odd, words.encode(odd)):
                assert np.frombuffer(got, words.dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_pair_replaces_the_smallest():
    # Greedy: 6 + 3 (gap 1); 3 makes way for 2 + 2.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
    assert packing._tightest_pair(np.array([0, 0, 2, 1, 0]), 4, 3) == [2, 2]
    assert packing._tightest_pair(np.array([0, 0, 1, 1, 0]), 4, 3) is None


def best_fit_decreasing(counts, capacity):
    gaps, bins = [0] * (capacity + 1), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                bins, gap = bins + 1, capacity
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return bins


def test_patterns_use_every_length_once():
    rng = np.random.default_rng(3)
    counts = {int(k): int(rng.integers(1, 500)) for k in rng.choice(np.arange(1, 101), 60, replace=False)}
    used = {}
    patterns = packing.best_two_fit(counts, 100)
    for times, chosen in patterns:
        assert sum(chosen) <= 100
        for length in chosen:
            used[length] = used.get(length, 0) + times
    assert used == counts
    assert sum(t for t, _ in patterns) <= best_fit_decreasing(counts, 100)


def check(rows, texts, capacity):
    """Pieces are those of the texts, and sequences are gapless."""
    whole = tokenizer()
    expected = []
    for doc, text in texts:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_edges(spark, edges):
    from deckflow.session import materialize

    cut = materialize(packing.pieces(edges, tokens.word_bpe(), capacity=64), "pieces")
    rows = packing.pack(cut, 64).collect()
    total = sum(r.length for r in rows)
    assert check(rows, [(r.doc_id, r.text) for r in edges.collect()], 64) <= -(-total // 64) + 2
    kept = packing.pieces(edges, tokens.word_bpe(), capacity=64, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in kept)


def test_one_length_for_a_third_and_an_empty_table(spark, edges):
    from deckflow.session import materialize

    docs = spark.createDataFrame([(i, "a b" if i % 3 else "c") for i in range(300)], "doc_id long, text string")
    rows = packing.pack(materialize(packing.pieces(docs, tokens.word_bpe(), capacity=7), "pieces"), 7).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()], 7) == 125
    assert packing.pack(packing.pieces(edges.limit(0), tokens.word_bpe())).count() == 0


def test_further_columns_keep_their_values(spark):
    rows = [(i, 0, 0, 1 + i % 5, i, f"b{i}", i * 2, i * 3, -1, "o") for i in range(60)]
    fields = packing.PIECE + ", bucket string, Rank long, before int, sequence_id int, offset string"
    got = packing.pack(spark.createDataFrame(rows, fields), 10)
    assert sorted(got.columns) == sorted(fields.replace(",", "").split()[::2])
    ends = {}
    for r in got.collect():
        assert (r.bucket, r.Rank, r.before) == (f"b{r.doc_id}", r.doc_id * 2, r.doc_id * 3)
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in ends.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
        assert sum(n for _, n in places) <= 10
    assert sum(map(len, ends.values())) == 60


def test_a_word_in_use_is_taken_apart_once(monkeypatch):
    matched = []

    class Parts:
        @staticmethod
        def fullmatch(word, pattern=tokens._PARTS):
            matched.append(word)
            return pattern.fullmatch(word)

    monkeypatch.setattr(tokens, "_PARTS", Parts)
    words = tokens.WordEncoder(tokens.word_bpe(), 10)
    for n in range(6):  # every call brings more words than the limit
        words.encode(["Often, " + " ".join(f"own{n}x{k}" for k in range(15))])
    assert matched.count("Often,") == 1
