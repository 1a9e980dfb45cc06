"""Chat formatting, fingerprints and mixing against plain Python."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from shoplytics.llm import chat, fingerprints, mixing
from tests.llm.frames import docs, rows, wider

CONV = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def formatted(spark, data):
    return chat.format_conversations(spark.createDataFrame(data, CONV))


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "|b", "<\\\\|x<|", "", None, "é\n\n<|im_sep|>", "\\", "<|", "$1\\1"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    data, want = [], {}
    for c in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", "we|ird\n%0A", None]), rng.choice(NASTY)) for t in range(rng.randint(1, 9))]
        want[c] = [((r or ""), (x or "")) for _, r, x in turns]
        data += [(c, t, r, x) for t, r, x in turns]
    rng.shuffle(data)
    f = formatted(spark, data)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_turns(f).collect()}
    assert got == want
    for r in rows(chat.digest(f)):
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_adjacent_turns_share_a_block(spark):
    text = formatted(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]).first().formatted
    assert text == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_chat_order_nulls_repeats_and_long_text(spark):
    data = [(1, 1, "user", "y" * 200_000), (1, None, "user", "first"), (1, 1, "user", "x"), (1, 1, "user", "x"), (None, 0, "user", "n")]
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_turns(formatted(spark, data)).collect()}
    assert got == {1: ["first", "x", "x", "y" * 200_000], None: ["n"]}


def test_chat_empty_table_and_clashing_columns(spark):
    assert rows(chat.digest(formatted(spark, []))) == []
    df = wider(spark.createDataFrame([(1, 0, "user", "a")], CONV), turns=1, segments=2, formatted="z", ROLE="x")
    assert chat.digest(chat.format_conversations(df)).first().n_turns == 1


# --- fingerprints

def _hash(*longs, seed=42):
    for v in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        seed -= (seed >> 63) << 64
    return seed


def anchors(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    h = [x - ((x >> 63) << 64) for x in (xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tokens)]
    k = fingerprints.K
    if len(h) < k:
        return [_hash(*h)] if h else []
    s = [_hash(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(h) - k + 1):
        window = s[i:i + k - 1]
        if min(window) in (window[0], window[-1]):
            out.append(_hash(*window[::2]))
    return out


def hex8(xs):
    return "".join(f"{x & 0xFFFFFFFF:08X}" for x in xs)


def near(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def check_fingerprints(df):
    got = sorted(rows(fingerprints.compare_with_edits(df)), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]))
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
    want = []
    for i, (known, doc_id, t) in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)][2]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, e = anchors(t), anchors(edited)
        want.append({"doc_id": doc_id if known else None, "n_chars": len(t), "edited_sha256": sha(edited), "fingerprint": hex8(a),
                     "edited_fingerprint": hex8(e), "near_edited": near(a, e), "near_next": near(a, anchors(nxt))})
    want.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]))
    assert got == want


def test_fingerprints_against_plain(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(60)] + ["über", "日本語", "x" * 50]
    made = [(i * 7 % 101 * 1000 - 5000, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 11, 40, 300])))) for i in range(90)]
    check_fingerprints(docs(spark, made))


def test_fingerprints_nulls_repeats_long_and_single(spark):
    check_fingerprints(docs(spark, [(None, "a b"), (3, None), (3, ""), (3, "q r s"), (3, "q r s"), (9, "z" * 100_000 + " \t\n y")]))
    check_fingerprints(docs(spark, [(5, "only one here")]))
    check_fingerprints(docs(spark, [(2**62, "far " * 20), (-(2**62), "away " * 30)]))


def test_fingerprints_empty_table_and_clashing_columns(spark):
    assert rows(fingerprints.compare_with_edits(docs(spark, []))) == []
    df = docs(spark, [(1, "a b c")], bucket="x", key="y", ghost=3, TEXT="no", anchors=1)
    assert fingerprints.compare_with_edits(df).first().n_chars == 5


def test_fingerprints_of_one_table_over_the_given_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_fingerprints(df)


def test_fingerprints_of_texts_without_a_syncmer(spark):
    """Of ten words, most texts hold no closed syncmer: still, only equal ones have equal fingerprints."""
    made = [(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(40)]
    assert sum(not anchors(t) for _, t in made) > 10
    got = rows(fingerprints.compare_with_edits(docs(spark, made + [(50, ""), (51, None)]), whole=True).orderBy("doc_id"))
    assert len({r["fingerprint"] for r in got[:40]}) == 40 and not any(r["fingerprint"] == "" for r in got[:40])
    assert [r["near_next"] for r in got] == [0.0] * 40 + [1.0, 0.0]
    for r, (_, t) in zip(got, made):
        assert not anchors(t) or r["fingerprint"] == hex8(anchors(t))
    assert [r["fingerprint"] for r in rows(fingerprints.fingerprints(docs(spark, made)).orderBy("doc_id"))] == [r["fingerprint"] for r in got[:40]]


def test_query_gives_texts_without_a_syncmer_an_anchor(spark, tmp_path):
    from shoplytics.llm import queries
    made = [(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(20)]
    docs(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.QUERIES["op3_fingerprints"](spark, str(tmp_path)))
    assert len({r["fingerprint"] for r in got}) == 20 and not any(r["near_next"] for r in got)


# --- mixing

def level_targets(size):
    """By rounds: share what is left by weight, stop those above their cap, again."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    return target


def check_mix(df, **how):
    data = df.select("doc_id", "text", "source").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {}
    for r in data:
        size[r.source] = size.get(r.source, 0) + count(r.text)
    target, got = level_targets(size), rows(mixing.mix(df, **how))
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in got) == sorted((str(r.doc_id), count(r.text), size[r.source]) for r in data)
    taken = {s: 0 for s in size}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) < 1.001
    return got


def test_mix_against_rounds(spark):
    rng = random.Random(5)
    made = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["hot"] * 9 + ["a", "b", "é", "z", None])) for i in range(300)] + [(900, "only one", "tiny"), (901, None, "none")]
    one = check_mix(docs(spark, made), block_words=16)
    two = check_mix(docs(spark, made).repartition(7), block_words=16)
    key = lambda r: r["doc_id"]
    assert [(r["doc_id"], r["taken"]) for r in sorted(one, key=key)] == [(r["doc_id"], r["taken"]) for r in sorted(two, key=key)]


def test_mix_repeats_nulls_long_and_empty(spark):
    check_mix(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "t"), (2, "w " * 50_000, "u")]), block_words=64)
    assert rows(mixing.mix(docs(spark, []))) == []
    assert {r["taken"] for r in check_mix(docs(spark, [(1, None, "s"), (2, "", None)]))} == {0}
    check_mix(docs(spark, [(1, "a b", "s")], size=5, sid=1, bucket=2, Row=4))


def test_schedule_is_exact_and_spread(spark):
    by = spark.createDataFrame([("a", 0, 10, 70.0, 7, 0), ("b", 1, 10, 10.0, 1, 7), ("c", 2, 10, 50.0, 5, 8)],
                               "source string, sid int, source_size long, target double, n_slots long, first_slot long")
    got = sorted((r.position, r.sid, r["rank"]) for r in mixing.schedule(by).collect())
    assert len(got) == 13
    for sid, n in ((0, 7), (1, 1), (2, 5)):
        assert [r for _, s, r in got if s == sid] == list(range(n))
    for i in range(1, 14):  # every beginning of the schedule is near the weights
        assert abs(sum(s == 0 for _, s, _ in got[:i]) - i * 7 / 13) <= 2


def test_mix_in_order(spark):
    rng = random.Random(6)
    made = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["hot"] * 9 + ["a", "b", None])) for i in range(200)]
    got = sorted(rows(mixing.interleaved(docs(spark, made), block_words=16)), key=lambda r: (r["position"], r["part"]))
    mixed = {r["doc_id"]: r for r in rows(mixing.mix(docs(spark, made), block_words=16))}
    taken, line, blocks = {}, {}, {}
    for r in got:
        assert 0 <= r["word_start"] and 0 < r["words"] and r["word_start"] + r["words"] <= mixed[r["doc_id"]]["size"]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["words"]
        line.setdefault(r["sid"], []).append(r)
        blocks.setdefault(r["position"], set()).add((r["sid"], r["block"]))
    assert taken == {i: r["taken"] for i, r in mixed.items() if r["taken"]}
    assert all(len(b) == 1 for b in blocks.values()) and len({next(iter(b)) for b in blocks.values()}) == len(blocks)
    for rs in line.values():  # a source's words come in the order of its line: each goes on where the last one stopped
        assert [r["block"] for r in rs] == sorted(r["block"] for r in rs)
        for a, b in zip(rs, rs[1:]):
            whole = a["word_start"] + a["words"] == mixed[a["doc_id"]]["size"]
            assert (b["word_start"] == 0) if whole else (b["doc_id"], b["word_start"]) == (a["doc_id"], a["word_start"] + a["words"])


def test_mixed_documents_come_whole(spark):
    df = docs(spark, [(i, "w " * 10, "ab"[i % 10 == 0]) for i in range(50)])
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    copies = {}
    for r in got.collect():
        assert r.text == "w " * 10
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    taken = {r["doc_id"]: round(r["taken"] / 10) for r in rows(mixing.mix(df))}
    assert all(copies.get(i, 0) == n for i, n in taken.items())
