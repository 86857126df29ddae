"""The per-row helpers against plain versions."""

import random
import struct

import numpy as np
import public_tokenizers
import tokenizers

from sensorloom.llm import ann, bpe, exact, lines, packing, pii, pigeonhole, quality, simhash, toxicity, urls
from sensorloom.llm.queries import byte_bpe_files


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_equals_the_table():
    draw = random.Random(2)
    for _ in range(800):
        a = "".join(draw.choice("abc") for _ in range(draw.randint(0, 25)))
        b = "".join(draw.choice("abc") for _ in range(draw.randint(0, 25)))
        most = draw.randint(0, 12)
        assert lines.edit_distance(a, b, 99) == slow_distance(a, b)
        assert (lines.edit_distance(a, b, most) <= most) == (slow_distance(a, b) <= most)


def test_line_prints_count_each_word_once():
    import xxhash

    found = [[b"the", b"the", b"ax", b"bo"], [b"one"], [str(i).encode() for i in range(700)]]
    prints = lines.Hashes().prints(found)
    for line, fp in zip(found, prints.tolist(), strict=True):
        words = set(line)
        counts = [sum(xxhash.xxh64_intdigest(w, 42) >> b & 1 for w in words) for b in range(64)]
        want = sum((2 * c > len(words)) << b for b, c in enumerate(counts))
        assert fp % (1 << 64) == want


def test_both_line_splitters_agree():
    for text in ("A b-c_d 12\nÉé x", "x", "", "a\n\nb\x1fc"):
        assert lines.split_lines(text) == [lines.normalised(line) for line in text.split("\n")]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.tokenizer(path)
    texts = ["", "Hello  World's 42!", "ΑΣ Σ é\u0301", "a<|endoftext|>b <|startoftext|>", "\u0895 中文 \U0001f600", "ab" * 3000, "\x00\x1f \u00a0"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_byte_tokens_equal_the_library():
    files = byte_bpe_files()
    library, own = tokenizers.Tokenizer.from_file(files[0]), packing.tokenizer(*files)
    for text in ["", " a  b\n\nc", "x<|endoftext|>y", "\u0895中", "don't 123 é!!"]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bins_hold_every_item_once_and_swaps_empty_bins():
    draw = random.Random(4)
    for _ in range(20):
        sizes = [draw.randint(1, 99) for _ in range(draw.randint(1, 200))]
        bins = packing.pack(sizes, 100)
        assert sorted(i for m in bins.members for i in m) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in m) == f <= 100 for m, f in zip(bins.members, bins.fill, strict=True))
    # Best fit needs three bins here, an exchange saves one.
    bins = packing.pack([6, 5, 4, 3, 2], 10)
    assert sum(1 for f in bins.fill if f) == 2


def test_leaves_part_all_slots():
    counts = {0: 50, 1: 1, 7: 3, 8: 9}
    found = exact.leaves(counts, depth=4, capacity=10)
    assert sorted(s for p, d in found for s in range(p << (4 - d), (p + 1) << (4 - d))) == list(range(16))
    assert all(d == 4 or sum(n for s, n in counts.items() if s >> (4 - d) == p) <= 10 for p, d in found)


def test_submasks_keep_all_but_k_parts():
    masks = pigeonhole.submasks(list(range(64)), 5, 2)
    assert len(masks) == 10 and all(min(bin(m).count("1") for m in masks) >= 36 for _ in (0,))


def test_fingerprint_of_short_and_blank_texts():
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tb")


def test_calibration_and_thresholds():
    assert urls.calibrated([]) == 0.0
    assert urls.calibrated([(990, 0, 5), (1010, 7, 0)]) <= (1010 / urls.BINS * 2 - 1) * urls.SPAN
    good, every = np.array([30, 1]), np.array([30, 10])
    assert pii.threshold(np.array([2.0, -1.0]), good, every) == 2.0


def test_ranking_and_toxicity_without_both_labels():
    flat = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0, dtype=bool))
    assert flat.scores(np.zeros((1, len(quality.NAMES))))[0] >= 0.7
    weights, _ = toxicity.fit(toxicity.Rows([]), np.zeros(0), toxicity.Rows([]), toxicity.Rows([]), 3)
    assert not weights.any()


def test_counterfactual_penalty_takes_weight_off_group_names():
    # Group 0 is named in every toxic text, group 1 in none; the insult (2) is in most.
    x = [([0, 2], [1.0, 1.0])] * 30 + [([0], [1.0])] * 10 + [([1], [1.0])] * 60
    toxic = np.array([1.0] * 40 + [0.0] * 60)
    before = [r for r in x]
    after = [([1 - p if p < 2 else p for p in places], values) for places, values in x]
    rows = toxicity.Rows(x)
    free, _ = toxicity.fit(rows, toxic, toxicity.Rows(before), toxicity.Rows(after), 3, penalty=0.0)
    held, _ = toxicity.fit(rows, toxic, toxicity.Rows(before), toxicity.Rows(after), 3, penalty=50.0)
    assert abs(held[0] - held[1]) < 0.2 * abs(free[0] - free[1]) and held[2] > 0


def test_graph_finds_the_nearest_centres():
    draw = np.random.default_rng(1)
    centres = ann.balanced_centres(ann.unit(draw.normal(size=(600, 8))), 8)
    graph, x = ann.Graph(centres), ann.unit(draw.normal(size=(50, 8)))
    lists, _ = graph.nearest(x, 4)
    best = (x @ centres.T).argmax(axis=1)
    assert (lists[:, 0] == best).mean() > 0.95


def test_word_bytes_round_trip():
    bpe_ = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    packed = b"".join(p[0] for p in next(bpe_.parts(["the cat"])))
    assert len(struct.unpack(f"<{len(packed) // 4}I", packed)) == 2
