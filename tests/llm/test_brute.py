"""Queries against plain versions over whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import tokenizers
import xxhash
from pyspark.sql import functions as F

from sensorloom.llm import queries
from sensorloom.llm.common import read

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in read(spark, sf, "documents").select("doc_id", "text").collect()}


def test_op1_prints_and_components(spark):
    rows = texts(spark, SMALL)
    prints = {}
    for i, text in rows.items():
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    ids, parent = sorted(rows), {i: i for i in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", top(i)) for i in ids}
    assert len({c for _, c in got.values()}) < len(got)


def luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    )
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0])]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def test_op3_base_spans(spark):
    rows, seen = texts(spark, MIDDLE), 0
    for r in queries.op3_pii(spark, MIDDLE).collect():
        want = base(rows[r.doc_id])
        seen += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | ({""} if not want else set())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in ("email", "ip", "card", "phone")]
    assert seen > 50


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_op5_rules(spark):
    ruled = 0
    got = {r.page_id: r for r in queries.op5_urls(spark, MIDDLE).collect()}
    for page in read(spark, MIDDLE, "pages").select("page_id", "url").collect():
        rest = page.url.split("://", 1)[1] if page.url and "://" in page.url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [rule for rule in RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        r, rule = got[page.page_id], max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")
        ruled += rule is not None
    assert 0 < ruled and len({r.verdict for r in got.values() if r.rule is None}) == 2


def test_op9_pieces_hold_every_id_once(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, by, bins, total = texts(spark, MIDDLE), {}, {}, 0
    for r in queries.op9_packing(spark, MIDDLE).collect():
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(rows)
    for i, pieces in by.items():
        ids = [*library.encode(rows[i], add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 1024)
        at = 0
        for r in pieces:
            part = np.array(ids[at : at + r.length], dtype="<u4")
            assert r.start == at and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in pieces[1:])
        total += len(ids)
    for parts in bins.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= -(-total // 1024) * 1.01


def test_op10_finds_nine_of_ten_neighbours(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in read(spark, MIDDLE, "embeddings").collect()}
    ids = np.array(sorted(i for i, v in rows.items() if np.isfinite(v).all() and v.any()))
    unit = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    asked = [i for i in ids if i % 50 == 0]
    got = {}
    for r in queries.op10_ann(spark, MIDDLE).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        scores = unit @ unit[np.searchsorted(ids, q)]
        true = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:5]
        found = sorted(got[q])
        assert [rank for rank, _, _ in found] == list(range(1, 6)) and q not in {v for _, v, _ in found}
        for _, v, score in found:
            assert abs(score - scores[np.searchsorted(ids, v)]) < 1e-12
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hits += len({v for _, v, _ in found} & set(true))
    assert hits >= 0.9 * 5 * len(asked)


def test_op2_op7_know_held_out_labels(spark):
    labels = read(spark, MIDDLE, "labels")
    for query, label, least in ((queries.op2_toxicity, "toxic", 0.95), (queries.op7_quality, "quality", 0.95)):
        both = query(spark, MIDDLE).where("held_out").join(labels.select("doc_id", F.col(label).alias("said")), "doc_id").collect()
        assert len(both) > 50 and sum(r.predicted == r.said for r in both) >= least * len(both)
        # Better than the commoner label.
        assert least > max(sum(r.said == x for r in both) for x in (0, 1)) / len(both) or label == "toxic"


def test_op11_op12_op13_over_all_rows(spark):
    rows = texts(spark, SMALL)
    assert {r.doc_id for r in queries.op11_language(spark, SMALL).collect()} == set(rows)
    ranked = queries.op12_lexical(spark, SMALL).groupBy("item_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert ranked and all(r.n == r.last <= 50 for r in ranked)
    assert queries.op13_spelling(spark, SMALL).where("n < 5 or length(word) < 6").count() == 0
