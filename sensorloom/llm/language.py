"""Language of a text: a bidirectional gated recurrent network over its bytes.

A text is read in pieces of bytes, forwards and backwards; at every byte both states
together give the chances of the languages, and the chances at a text's letters are
averaged.  The network is trained in numpy by backpropagation through time on
a bounded sample of pieces, each of whose letters carries the language of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common, labelled

# Bytes of a piece, units of a direction, pieces read side by side.
PIECE, UNITS, SIDE = 128, 8, 1024
# Parameters of the training: documents of a language, pieces of a document, steps, pieces of a step, pace.
DOCS, PIECES, STEPS, BATCH, RATE = 800, 3, 150, 96, 0.02
# No byte: behind the end of a text.
NONE = 256
LETTER = np.array([b >= 128 or bytes([b]).isalpha() for b in range(256)] + [False])

UNKNOWN = "und"

Weights = dict[str, np.ndarray]


def start(languages: int, *, units: int = UNITS, seed: int = 11, kind: type = np.float32) -> Weights:
    """Weights before training; first axis of the recurrent ones is the direction."""
    draw = np.random.default_rng(seed)
    return {
        # Per byte: update gate, reset gate, candidate.
        "byte": draw.normal(0, 0.3, (2, 257, 3 * units)).astype(kind),
        "state": draw.normal(0, units**-0.5, (2, units, 3 * units)).astype(kind),
        "label": draw.normal(0, units**-0.5, (2, units, languages)).astype(kind),
        "bias": np.zeros(languages, dtype=kind),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _both(codes: np.ndarray) -> np.ndarray:
    """Pieces as read forwards and backwards, by step: (step, direction, piece)."""
    return np.ascontiguousarray(np.stack([codes.T, codes[:, ::-1].T], axis=1))


def _label(w: Weights, states: np.ndarray) -> np.ndarray:
    """Chances of the languages at each byte, (step, piece, language), from states by reading step."""
    logits = np.matmul(states[:, 0], w["label"][0])
    logits += np.matmul(states[::-1, 1], w["label"][1])
    logits += w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def chances(w: Weights, codes: np.ndarray) -> np.ndarray:
    """Chances of the languages at every byte of pieces ``codes``: (piece, byte, language)."""
    pieces, length = codes.shape
    units = w["state"].shape[1]
    read = _both(codes)
    # A gate is a sigmoid, half a tanh of half its input: both gates in one call.  The
    # half before the candidate's inner part is taken with its weights.
    half = np.repeat(np.array([0.5, 0.5, 1], dtype=w["byte"].dtype), units)
    # Pieces are the last axis: whatever is done to a unit runs over all of them.
    byte = np.ascontiguousarray((w["byte"] * half).transpose(0, 2, 1))
    state = np.ascontiguousarray((w["state"] * 0.5).transpose(0, 2, 1))
    h = np.zeros((2, units, pieces), dtype=byte.dtype)
    x, g = np.empty((2, 3 * units, pieces), dtype=byte.dtype), np.empty((2, 3 * units, pieces), dtype=byte.dtype)
    states = np.empty((length, 2, units, pieces), dtype=byte.dtype)
    live = read != NONE
    ended = ~live.all(axis=2)
    for t in range(length):
        for d in range(2):
            np.take(byte[d], read[t, d], axis=1, out=x[d], mode="clip")
        np.matmul(state, h, out=g)
        gates = x[:, : 2 * units]
        gates += g[:, : 2 * units]
        np.tanh(gates, out=gates)
        gates += 1
        candidate = g[:, 2 * units :]
        candidate *= gates[:, units:]
        candidate += x[:, 2 * units :]
        np.tanh(candidate, out=candidate)
        update = gates[:, :units]
        update *= 0.5
        h -= candidate
        h *= update
        h += candidate
        # Behind a text's end the state stays: backwards reading starts there.
        for d in range(2):
            if ended[t, d]:
                h[d] *= live[t, d]
        states[t] = h
    turned = np.ascontiguousarray(w["label"].transpose(0, 2, 1))
    p = np.matmul(turned[0], states[:, 0])
    p += np.matmul(turned[1], states[::-1, 1])
    p += w["bias"][:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p.transpose(2, 0, 1)


def gradient(w: Weights, codes: np.ndarray, language: np.ndarray) -> tuple[float, Weights]:
    """Mean loss at the letters of ``codes`` and its gradient, backwards through all steps."""
    pieces, length = codes.shape
    units = w["state"].shape[1]
    read, live = _both(codes), (_both(codes) != NONE)[..., None]
    h = np.zeros((2, pieces, units), dtype=w["byte"].dtype)
    states = np.empty((length, 2, pieces, units), dtype=h.dtype)
    kept = []
    for t in range(length):
        x = np.stack([w["byte"][d][read[t, d]] for d in range(2)])
        g = np.matmul(h, w["state"])
        update = _sigmoid(x[..., :units] + g[..., :units])
        reset = _sigmoid(x[..., units : 2 * units] + g[..., units : 2 * units])
        candidate = np.tanh(x[..., 2 * units :] + reset * g[..., 2 * units :])
        kept.append((h, update, reset, candidate, g[..., 2 * units :]))
        h = (update * h + (1 - update) * candidate) * live[t]
        states[t] = h
    p = _label(w, states)
    letter = LETTER[codes].T
    count = max(1, int(letter.sum()))
    at = p[:, np.arange(pieces), language]
    loss = float(-np.log(np.maximum(at[letter], 1e-30)).sum() / count)
    error = p.copy()
    error[:, np.arange(pieces), language] -= 1
    error *= (letter / count)[..., None].astype(error.dtype)
    out = {name: np.zeros_like(value) for name, value in w.items()}
    out["bias"] += error.sum(axis=(0, 1))
    out["label"][0] = np.einsum("tpu,tpl->ul", states[:, 0], error, optimize=True)
    out["label"][1] = np.einsum("tpu,tpl->ul", states[::-1, 1], error, optimize=True)
    back = np.stack([np.matmul(error, w["label"][0].T), np.matmul(error[::-1], w["label"][1].T)], axis=1)
    down = np.zeros_like(h)
    turned = w["state"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        before, update, reset, candidate, inner = kept[t]
        down = (down + back[t]) * live[t]
        to_candidate = down * (1 - update) * (1 - candidate**2)
        to_update = down * (before - candidate) * update * (1 - update)
        to_reset = to_candidate * inner * reset * (1 - reset)
        from_byte = np.concatenate([to_update, to_reset, to_candidate], axis=2)
        from_state = np.concatenate([to_update, to_reset, to_candidate * reset], axis=2)
        for d in range(2):
            np.add.at(out["byte"][d], read[t, d], from_byte[d])
        out["state"] += np.matmul(before.transpose(0, 2, 1), from_state)
        down = down * update + np.matmul(from_state, turned)
    return loss, out


def train(codes: np.ndarray, language: np.ndarray, languages: int, *, steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> Weights:
    """Weights from pieces and their languages: Adam with a falling pace, languages drawn alike often."""
    w = start(languages)
    draw = np.random.default_rng(seed)
    by = [np.flatnonzero(language == k) for k in range(languages)]
    mean, square = ({name: np.zeros_like(v) for name, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = np.concatenate([draw.choice(rows, -(-batch // languages)) for rows in by if len(rows)])
        _, g = gradient(w, codes[rows], language[rows])
        # Steep places are taken at unit length.
        short = min(1.0, 1.0 / max(1e-12, float(np.sqrt(sum((v**2).sum() for v in g.values())))))
        pace = RATE * (1 - (step - 1) / steps)
        for name, v in g.items():
            mean[name] += 0.1 * (short * v - mean[name])
            square[name] += 0.01 * ((short * v) ** 2 - square[name])
            w[name] -= pace * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
    return w


def pieces(raw: bytes) -> np.ndarray:
    """The bytes of a whole text in rows of a piece, the last one filled up with ``NONE``."""
    rows = -(-len(raw) // PIECE)
    out = np.full(rows * PIECE, NONE, dtype=np.int16)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(rows, PIECE)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def pooled(w: Weights, texts: list[str]) -> np.ndarray:
    """Mean chances of the languages over the letters of each text; whole texts, some pieces at a time."""
    languages = len(w["bias"])
    # Fewer pieces at once where there are many languages.
    side = max(16, min(SIDE, SIDE * 16 // languages))
    total, letters = np.zeros((len(texts), languages)), np.zeros(len(texts))
    rows, owner, held = [], [], 0

    def flush() -> None:
        nonlocal rows, owner, held
        codes, own = np.concatenate(rows), np.concatenate(owner)
        letter = LETTER[codes]
        p = chances(w, codes) * letter[..., None]
        np.add.at(total, own, p.sum(axis=1, dtype=np.float64))
        np.add.at(letters, own, letter.sum(axis=1))
        rows, owner, held = [], [], 0

    for number, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), side * PIECE):
            part = pieces(raw[at : at + side * PIECE])
            if held and held + len(part) > side:
                flush()
            rows.append(part)
            owner.append(np.full(len(part), number))
            held += len(part)
    if held:
        flush()
    return total / np.maximum(letters, 1)[:, None]


def training_pieces(docs: DataFrame, folds: int, held: int, size: int) -> DataFrame:
    """``lang, place, piece`` of up to about ``size`` documents of each language outside fold ``held``.

    Some pieces of each, spread over the whole text from a hashed place on.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("t"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang is not null and t is not null").where(~labelled.in_fold(F.col("id"), folds, held))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"))
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit("lang")), 1).cast("double") / float(1 << 63)
    # One row per language.
    drawn = known.join(F.broadcast(counts), "lang").withColumn("place", place).where(F.col("place") * F.col("count") < size)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, place, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "place", "t")), strict=True):
                if not _has_letter(text):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                every = max(PIECE, len(raw) // PIECES)
                shift = int(place * 1e6) % max(1, min(every, len(raw)) - PIECE + 1)
                rows += [(lang, place, raw[at : at + PIECE]) for at in range(shift, len(raw), every)[:PIECES]]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.binary())],
                ["lang", "place", "piece"],
            )

    return drawn.select("lang", "place", "t").mapInArrow(cut_out, "lang string, place double, piece binary")


def identified(docs: DataFrame, *, folds: int = 4, held: int = 2, sample: int = DOCS, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per row of ``docs (doc_id, text, lang)``.

    Trained on pieces of about ``sample`` documents of each language outside the
    held-out fold at most; ``lang``, ids and other columns are never inputs of a
    prediction, which reads the whole text.  Null texts and texts without a letter
    are ``und`` with score 0, as is every text where no language is known.  Repeated
    rows are each reported, a null doc_id is in no fold, no rows give no rows.
    """
    common.prepare(docs.sparkSession)
    # At most ``sample`` times PIECES pieces of a language; sorted, so that every run draws the same.
    found = sorted((r.lang, r.place, bytes(r.piece)) for r in training_pieces(docs, folds, held, sample).collect())
    names = sorted({lang for lang, _, _ in found})
    w = None
    if names:
        codes = np.concatenate([pieces(piece) for _, _, piece in found])
        w = train(codes, np.array([names.index(lang) for lang, _, _ in found]), len(names), steps=steps)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, text in enumerate(texts) if w is not None and _has_letter(text)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            p = pooled(w, [texts[i] for i in known]) if known else None
            for row, i in enumerate(known):
                best = int(p[row].argmax())
                lang[i], score[i] = names[best], min(1.0, max(0.0, float(p[row, best])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = common.texts(docs).mapInArrow(label, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", labelled.in_fold(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred", "score")
