"""The ten operators against brute-force versions, on the small tables and on hand-made edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from evidence_spark.llm import chat, components, ftrl, media, minhash, mixing, packing, pii, pq, quality, queries, sharding, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, None, "en", None, 0),
    (2, "", "en", "b", 0),
    (3, " \n\t ", None, "b", 3),
    (4, "one", "en", "b", 3),
    (5, "Same Words here again and again", "en", "a", 9),
    (6, "same words HERE again and again", "en", "a", 9),
    (7, "same words HERE again and again", "en", "a", 9),
    (7, "same words HERE again and again", "en", "a", 9),
    (None, "no id at all but a text", "de", "é", 1),
    (8, "long " * 40_000 + "é€😀 end", "fr", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def edge(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, SCHEMA).withColumns({"size": F.lit("x"), "shard": F.lit(-1), "score": F.lit(2), "spans": F.lit(1), "key": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- sharding


def check_shards(found, texts):
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in texts)
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[s]) for s in range(8)]


def test_sharding(spark, docs):
    found = rows(queries.op1_sharding(spark, SMALL))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = check_shards(found, texts)
    want = {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts}
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for r in found)
    assert max(sizes) - min(sizes) <= 2 * max(w[0] for w in want.values())
    assert found[0]["law"] == "bytes" and found[0]["grown_shard"] is None


def test_sharding_edges(spark, edge, empty):
    found = rows(sharding.shard_by_bytes(edge))
    check_shards(found, [(r[0], r[1]) for r in EDGE])
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_splits_a_hot_group_and_keeps_small_ones(spark):
    made = [(i, "hot " * 5) for i in range(600)] + [(1000 + i, f"text {i // 3}") for i in range(1200)]
    found = rows(sharding.shard_by_bytes(spark.createDataFrame(made, "doc_id long, text string")))
    sizes = check_shards(found, made)
    assert max(sizes) - min(sizes) < 0.05 * max(sizes)
    where = defaultdict(set)
    for r in found:
        where[r["text_crc32"]].add(r["shard"])
    assert len(where[zlib.crc32(b"hot " * 5)]) > 1
    assert all(len(s) == 1 for crc, s in where.items() if crc != zlib.crc32(b"hot " * 5))


# --- mixing


def brute_targets(sizes, share=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out = share * sum(sizes.values()), {}
    free = set(names)
    while free:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: limit * sizes[s] for s in over}
        free -= over
    return out


def check_mix(found, source_of, tolerance):
    words = Counter()
    for r in found:
        words[source_of[r["doc_id"]]] += r["size"]
    target, taken = brute_targets(dict(words)), Counter()
    longest = Counter()
    for r in found:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == words[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in words:
        assert abs(taken[s] - target[s]) <= max(tolerance * longest[s], 1)


def test_mixing(spark, docs):
    one, two = (sorted(map(str, rows(queries.op3_mixing(spark, SMALL)))) for _ in range(2))
    assert one == two
    found = rows(queries.op3_mixing(spark, SMALL))
    want = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in docs.collect()}
    assert all(want[r["doc_id"]][1] == r["size"] for r in found) and len(found) == len(want)
    check_mix(found, {d: s for d, (s, _) in want.items()}, 1)


def test_mixing_edges(spark, edge, empty):
    found = rows(mixing.mix_plan(edge))
    assert len(found) == len(EDGE)
    for r in found:
        r["taken"] = len(r["draws"]) * r["size"]
    check_mix(found, {r[0]: r[3] for r in EDGE}, 1)
    assert mixing.mix_plan(empty).count() == 0


def test_mixing_tree_gives_exact_disjoint_quotas(spark):
    made = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3000)]
    plan = mixing.mix_plan(spark.createDataFrame(made, "doc_id long, text string, source string"), shards=5, blocks=64)
    draws = [(r.source, d.repeat, d.shard, r.doc_id, d.order) for r in plan.collect() for d in r.draws]
    assert {d[2] for d in draws} == set(range(5))
    assert len({(d[1], d[3]) for d in draws}) == len(draws)
    per = Counter(d[2] for d in draws)
    assert max(per.values()) < 1.25 * min(per.values())
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    assert mixing.mixed(docs, shards=5, blocks=64).count() == len(draws)


def test_op3_rows_come_from_the_tree(spark):
    """Draws of the query's own rows: disjoint blocks, shards that hold what the tree's leaves say, near equal loads."""
    found = rows(queries.op3_mixing(spark, SMALL))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    draws = [(source[r["doc_id"]], r["doc_id"], *map(int, d.split(":"))) for r in found for d in filter(None, r["draws"].split(","))]
    assert sum(r["taken"] for r in found) == sum(r["size"] * len(r["draws"].split(",")) for r in found if r["draws"])
    where = defaultdict(set)
    for s, _, repeat, shard, block, unit, _ in draws:
        where[s, unit].add((repeat, shard, block))
    assert all(len(v) == 1 for v in where.values())  # a unit is one block of one pass, in one shard
    units = {(s, *next(iter(v))): u for (s, u), v in where.items()}
    assert len(units) == len(where) and len({(s, r, b) for s, r, _, b in units}) == len(where)
    # a shard takes a run of each source's permuted list, and shards follow each other
    for s in set(source.values()):
        mine = sorted((u, sh) for (t, _, sh, _), u in units.items() if t == s)
        assert [sh for _, sh in mine] == sorted(sh for _, sh in mine)
    per_shard = Counter(sh for _, _, sh, _ in units)
    assert set(per_shard) == set(range(16)) and max(per_shard.values()) - min(per_shard.values()) <= 0.5 * max(per_shard.values())


def test_split_tree_gives_exact_sums(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 3), (2, 0), (3, 297)], "_place int, units long")
    ends = {r["_place"]: r.ends for r in mixing._split_tree(quotas, 7, 5).collect()}
    counts = {k: [b - a for a, b in zip([0, *v], v)] for k, v in ends.items()}
    assert all(sum(counts[k]) == n and min(counts[k]) >= 0 for k, n in ((0, 700), (1, 3), (2, 0), (3, 297)))
    per_shard = [sum(c[i] for c in counts.values()) for i in range(7)]
    assert max(per_shard) - min(per_shard) <= 3 and len(set(counts[3])) > 1  # drawn, not dealt evenly


def test_mixed_rows_equal_the_plan(spark):
    same = [(5, "a b c d e f g h", "s", "x", 1, 2)] * 7
    null = [(None, "q r s", src, "y", 3, 4) for src in ("s", "t", None)]
    more = [(100 + i, f"w{i} " * (1 + i % 5), "stu"[i % 3], None, None, None) for i in range(60)]
    docs = spark.createDataFrame(same + null + more + [(90, None, "s", "", 0, 0), (91, " ", "s", "", 0, 0)], "doc_id long, text string, source string, `repeat` string, _text int, _id int")
    plan = rows(mixing.mix_plan(docs))
    got = rows(mixing.mixed(docs))
    want = Counter(r["doc_id"] for r in plan for _ in r["draws"])
    assert Counter(r["doc_id"] for r in got) == want and sum(want.values()) == len(got)
    assert {"repeat", "_text", "_id"} <= set(got[0]) and {r["repeat"] for r in got if r["doc_id"] == 5} == {"x"}
    assert sorted((d["shard"], d["order"]) for r in plan for d in r["draws"]) == sorted((r["_shard"], r["_order"]) for r in got)
    assert sorted(map(str, rows(mixing.shuffled(mixing.mixed(docs))))) == sorted(str({k: v for k, v in r.items() if k not in ("_shard", "_order")}) for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_packs(found, texts, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, copies in ids.items():
        assert sorted((r["start"], r["length"]) for r in by_doc[d]) or True
        assert sum(r["length"] for r in by_doc[d]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(copies[0])
                assert r["ids_crc32"] == zlib.crc32(copies[0][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(copies[0])
    pad = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    assert pad <= 0.01 * total


def test_packing(spark, docs, tokenizer):
    found = rows(queries.op4_packing(spark, SMALL))
    check_packs(found, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)


def test_packing_edges(spark, edge, empty, tokenizer):
    check_packs(rows(packing.pack_documents(edge, tokenizer)), [(r[0], r[1]) for r in EDGE], tokenizer)
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_word_tokens_equal_the_tokenizer(tokenizer):
    own = packing.WordTokens(tokenizer, keep=50)
    rng = random.Random(1)
    letters = "abcXYZ '’.,-12½éÉßŸǅΣσςİñ  \n\t<|>$%😀日本ÅÅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["it's we'll THEY'RE don't'd", "<|endoftext|> x", "a" * 5000, "", "  ", "x²³¹ ¼"]
    for t in texts:
        assert own.ids(t).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_tokens_of_many_texts(tokenizer):
    # small letters beyond the table, short forms, texts that only UTF-16 holds, groups of a few texts, words that are not kept
    own = packing.WordTokens(tokenizer, keep=20, group=40)
    texts = ["Ɓa Ⱥb", "x's's ''s !'s 'll'RE'd1 'somewhere", "œuvre Œ's", "", "  ", "\n", "<|endoftext|>x", "日本 a", "a\xa0b\xad c"]
    texts += [f"{chr(c)}a {chr(c)}'S1{chr(c)}" for c in range(1, 0x260)] + ["one two three one", "two"] * 3
    for t, got in zip(texts, own.many(texts), strict=True):
        assert got.tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert len(own.at) == 20


# --- personal data


def brute_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "x@y.z", "+1 (262) 555-3752", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "-", " ", "é", "00", "255", "+", "(", "12", "%", "@@", ".com"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        mine = ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(pii.base_spans(t), key=lambda x: (x[0], pii.KINDS.index(x[2]))))
        assert mine == brute_spans(t), t


def test_pii(spark, docs):
    found = {r["doc_id"]: r for r in rows(queries.op5_pii(spark, SMALL))}
    for r in docs.collect():
        want, got = brute_spans(r.text), found[r.doc_id]
        assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.KINDS[:4]] == [want.count(f"{k}:") for k in pii.KINDS[:4]]
        assert set(filter(None, want.split(","))) <= set(got["spans"].split(","))


def test_pii_edges(spark, edge, empty):
    found = pii.personal_spans(edge)
    assert found.count() == len(EDGE) and all(r.spans == [] for r in found.collect())
    assert pii.personal_spans(empty).count() == 0
    made = spark.createDataFrame([(1, 'key "password=abc12345xyz" and mail a.b@c.org, 10.0.0.1'), (2, None), (3, "a" * 200_000 + "1" * 200_000)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(made).collect()}
    assert "a.b@c.org" not in clean[1] and "[EMAIL]" in clean[1] and "[IP]" in clean[1] and clean[2] is None and len(clean[3]) == 400_000


def test_em_trusts_labelers_that_agree():
    model = pii.fit_spans([("email", "1-111", "mnvss", 900), ("email", "1-1-1", "mnvss", 800), ("email", "1-0-0", "mnvww", 40), ("local_phone", "---11", "mdfss", 50), ("local_phone", "----0", "mdfww", 60)])
    assert model.probability("local_phone", "---11", "mdfss") > 0.5 > model.probability("local_phone", "----0", "mdfww")
    assert model.reliability["shape"][0] > model.reliability["shape"][1]


def test_labelers_propose_spans(spark):
    told = {
        1: ("please call 262 5553752 now", "local_phone", "262 5553752"),
        2: ("write to jane.doe at mail dot example dot com today", "masked_email", "jane.doe at mail dot example dot com"),
        3: ("my ssn 123456789 is here", "national_id", "123456789"),
        4: ("the password is hunter2hunter2", "secret", "hunter2hunter2"),
        5: ("use ghp_abcdEFGH0123456789ijkl for it", "secret", "ghp_abcdEFGH0123456789ijkl"),
    }
    plain = {6: "the call came at noon and dot com firms fell", 7: "token rings and a secret garden", 8: "at 12 dot 5"}
    made = [(i, t[0]) for i, t in told.items()] + list(plain.items()) + [(100 + i, f"mail user{i}@host{i}.org or +1 (262) 555-{1000 + i}") for i in range(40)]
    found = {r.doc_id: [(x["kind"], x["start"], x["end"]) for x in r.spans] for r in pii.personal_spans(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, (t, kind, value) in told.items():
        assert found[i] == [(kind, t.index(value), t.index(value) + len(value))], (i, found[i])
        labelers = {x[3][0] for x in pii.candidates(t)}
        assert labelers == {"0"}  # no regex of a kind proposes these
    assert all(not found[i] for i in plain)


def test_redact_edges(spark, edge, empty):
    want = {r[0]: r[1] for r in EDGE}
    assert all(r.text == want[r.doc_id] for r in pii.redact(edge).collect()) and pii.redact(edge).columns == edge.columns
    assert pii.redact(empty).count() == 0


# --- chats


def test_chat_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op6_chat"]).fetchall()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = [tuple(r[n] for n in names) for r in rows(queries.op6_chat(spark, SMALL))]
    assert sorted(got) == sorted(want)


def test_chat_escapes_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>user\n", "<\\|x", "<\\\\|", "<", "|", "<|<|", None, "", "a\nb", "\\", "<|im_end|>", "<\\\\\\|im_end|>\n"]
    made = [(7, i, r, t) for i, (t, r) in enumerate((t, r) for t in texts for r in ("assistant", "us\ner%0A<|", None))]
    df = chat.format_chats(chat.row_events(spark.createDataFrame(made, "conv_id int, turn int, role string, text string")))
    from pyspark.sql import functions as F

    r = df.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [(x["role"], x["text"]) for x in r.t] == [(role or "", t or "") for _, _, role, t in made]
    assert r.l == [t or "" for _, _, role, t in made if role == "assistant"]


def test_chat_query_exercises_the_fold(spark):
    made = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", None), (1, None, None, "x"), (1, 1, "assistant", "ab")], "conv_id int, turn int, role string, text string")
    log = chat.row_events(made)
    kinds = Counter(r.kind for r in log.collect())
    assert kinds == {"delta": 16, "edit": 4, "regenerate": 4}
    plain = "".join(r.text for r in log.filter("role = 'user'").orderBy("seq").collect())
    assert plain != "hello there"
    folded = sorted((r.seq, r.role, r.text) for r in chat.fold_events(log.repartition(5)).collect())
    assert folded == [(-(1 << 40), "", "x"), (0, "user", "hello there"), (8, "assistant", ""), (8, "assistant", "ab")]


def test_chat_folds_events(spark):
    log = [(1, 1, 0, "user", "delta", "Hi "), (1, 1, 1, "user", "delta", "there"), (1, 2, 2, "assistant", "delta", "bad"), (1, 2, 3, "assistant", "regenerate", None), (1, 2, 600, "assistant", "delta", "go"), (1, 2, 601, "assistant", "delta", "od"), (1, 1, 602, "user", "edit", "Hello"), (1, 1, 603, "user", "delta", "!"), (1, 3, 700, "user", "delta", "x"), (1, 3, 999, "user", "delete", None)]
    df = chat.fold_events(spark.createDataFrame(log, "conv_id int, message int, seq int, role string, kind string, text string"))
    assert sorted((r.message, r.role, r.text) for r in df.collect()) == [(1, "user", "Hello!"), (2, "assistant", "good")]
    none = spark.createDataFrame([], "conv_id int, message int, seq int, role string, kind string, text string")
    assert chat.format_chats(none).count() == 0
    same = spark.createDataFrame([(1, 0, "user", "a")] * 3 + [(None, None, None, None)], "conv_id int, turn int, role string, text string")
    assert sorted(r.formatted.count("im_start") for r in chat.format_chats(chat.row_events(same)).collect()) == [1, 3]


# --- media


def test_media(spark, docs):
    found = {r["doc_id"]: r for r in rows(queries.op7_media(spark, SMALL))}
    for r in docs.collect():
        data = r.text.encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        got = found[r.doc_id]
        assert (got["n_bytes"], got["payload_bytes"]) == (len(data), len(payload))
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.text_media(r.text)
        assert (got["media_bytes"], got["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_edges(spark, edge, empty):
    found = rows(media.media_features(media.store_texts(edge)))
    assert len(found) == len(EDGE) and all(r["payload_bytes"] % 192 == 0 for r in found)
    assert media.media_features(media.store_texts(empty)).count() == 0
    clash = media.media_features(media.store_texts(edge).selectExpr("*", "1 as feature", "2 as tile", "3 as `a.b`"))
    assert clash.columns.count("feature") == clash.columns.count("tile") == 1 and all(len(r.feature) == 16 and r["a.b"] == 3 for r in clash.collect())
    bad = spark.createDataFrame([(1, b"P6\n3"), (2, None), (3, b"BM"), (4, b"")], "doc_id long, media binary")
    assert all(r.feature is None for r in media.media_features(bad).collect())


def test_images_decode_and_resize():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (64, 7)):
        x = rng.integers(0, 256, (h, w, 3), np.uint8)
        assert (media.decode(media.encode_ppm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P5 # note\n2 2\n255\n\x01\x02\x03\x04")[:, :, 0].tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P4\n3 1\n\xa0")[:, :, 0].tolist() == [[0, 255, 0]]
    x = rng.random((12, 18))
    assert np.allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.kron(x, np.ones((5, 7)))
    assert np.allclose(media.area_resize(x, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))


# --- near-duplicates


def brute_components(sets, percent):
    ids = list(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            index[s].add(i)
    for i in ids:
        near = Counter(j for s in sets[i] for j in index[s] if j > i)
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text, words) for r in docs.select("doc_id", "text").collect()}
    want = brute_components(sets, 80)
    for r in minhash.near_duplicates(docs, words=words).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want)


def test_minhash_families_and_chains(spark):
    rng = random.Random(3)
    made, base = [], [f"w{i}" for i in range(60)]
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(80)]
    for i in range(20):
        chain[i * 4 % 80] = f"y{i}"
        made.append((1000 + i, " ".join(chain)))
    sets = {d: shingles(t, 2) for d, t in made}
    want = brute_components(sets, 80)
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=2).collect()} == want


def test_minhash_edges(spark, edge, empty):
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(edge, words=2).collect()]
    assert len(found) == len(EDGE)
    got = {f[0]: f[1:] for f in found}
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[5] == (5, 5, True) and got[7] == (5, 5, False) and got[None][1:] == (None, False)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_links_rows_without_ids_and_all_texts_of_an_id(spark):
    base = [f"w{i}" for i in range(40)]
    near, far = " ".join([*base[:-1], "x"]), " ".join(f"z{i}" for i in range(40))
    made = [(None, " ".join(base)), (None, near), (9, far), (9, " ".join([*base[:-1], "y"])), (3, far + " more"), (None, "alone here"), (None, "alone here")]
    found = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), words=2).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found)
    # both texts of id 9 take part: one with the rows without ids, one with id 3
    assert got == sorted([("None", 39, "9", False)] * 2 + [("9", 39, "9", True), ("9", 39, "3", False), ("3", 40, "3", True)] + [("None", 1, "None", False)] * 2)


def test_minhash_blocks_of_a_large_bucket(spark, monkeypatch):
    rng, made, base = random.Random(8), [], [f"w{i}" for i in range(50)]
    for i in range(240):  # few pairs reach 0.8, so one bucket holds many components
        w = list(base)
        for k in rng.sample(range(50), 5 + i % 3):
            w[k] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    want = brute_components({d: shingles(t, 2) for d, t in made}, 80)
    monkeypatch.setattr(minhash, "BLOCK", 40)
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=2).collect()} == want


def test_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    got = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        one, two = (np.frombuffer(minhash.packed(minhash.minima(s)), np.uint8) for s in (x[:900], x[100:]))
        got.append(float(minhash.estimate(one, two[None])[0]))
    assert abs(np.mean(got) - 0.8) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}


# --- classifiers


def test_classifiers_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    for query, label, floor in ((queries.op9_quality, "quality", 0.98), (queries.op2_toxicity, "toxic", 0.98)):
        held = [r for r in query(spark, base).collect() if r.held_out and r.doc_id in labels]
        assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in held)
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in held]) >= floor


def test_classifiers_take_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        got = f(edge, labels)
        assert got.count() == len(EDGE) and all(0 <= r.score <= 1 for r in got.collect())
        assert f(empty, labels.limit(0)).count() == 0


def test_restoring_disguised_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    model = toxicity.language_model(toxicity.count_trigrams(docs.union(spark.createDataFrame([("the stupid idiot and the worthless moron " * 50,)], "text string"))))
    own = toxicity.Restorer(model)
    for told, meant in (("st*pid".replace("*", "u"), "stupid"), ("1d10t", "idiot"), ("stuuuupid", "stupid"), ("i d i o t", "idiot"), ("w0rthl3$s", "worthless"), ("worthles$", "worthless"), ("the and of", "the and of")):
        assert own.restore(told) == meant
    assert len(own.restore("a1" * 50_000)) > 0 and own.restore(None) == ""


def test_ftrl_learns_a_line():
    rng = np.random.default_rng(1)
    model = ftrl.Ftrl(20, 0.5, 1.0, 0.1, 0.0)
    for _ in range(4000):
        at = rng.choice(20, 5, replace=False)
        model.step(at, np.ones(5), float(0 in at))
    assert model.w[0] > 2 and np.abs(model.w[1:20]).max() < model.w[0]


# --- vectors


def brute_vectors(vectors, cosine=0.95):
    """Links between all rows whose vectors are sound and of equal length: (number of links, least id that is reached) by row."""
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and bool(np.any(np.array(v, float))) for _, v in vectors]
    hit = np.zeros((n, n), bool)
    for d in {len(v) for (_, v), g in zip(vectors, ok) if g}:
        at = [k for k in range(n) if ok[k] and len(vectors[k][1]) == d]
        x = np.array([np.array(vectors[k][1], float) / np.linalg.norm(np.array(vectors[k][1], float)) for k in at])
        hit[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    group = np.arange(n)
    while True:
        new = np.array([min(group[k], group[hit[k]].min(initial=n)) for k in range(n)])
        if (new == group).all():
            break
        group = new
    least = {g: min((vectors[k][0] for k in np.flatnonzero(group == g) if vectors[k][0] is not None), default=None) for g in set(group.tolist())}
    return [(vectors[k][0], int(hit[k].sum()), least[group[k]]) for k in range(n)]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 32))
    x[400:600] = x[0] + 0.18 * rng.normal(size=(200, 32)) * np.abs(x[0]).mean()
    x[600:] = x[100:200] + 0.1 * rng.normal(size=(100, 32))
    made = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    made += [(8000 + k, made[k // 7][1]) for k in range(140)] + [(8500, made[450][1]), (8501, made[450][1])]  # exact copies
    made += [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0, None] + [0.0] * 30), (9005, []), (9006, [1.0])]
    want = {i: (n, c) for i, n, c in brute_vectors(made)}
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pq.near_vectors(df, per_list=40).collect()}
    links = sum(w[0] for w in want.values())
    assert links > 10_000
    assert sum(min(got[i].n_links, w[0]) for i, w in want.items()) >= 0.99 * links
    assert all(got[i].n_links <= w[0] for i, w in want.items())
    assert np.mean([got[i].component_id == w[1] for i, w in want.items()]) > 0.99
    exact = {r.vec_id: r for r in pq.near_vectors(df, per_list=40, probe_share=1.0).collect()}
    assert all((exact[i].n_links, exact[i].component_id) == w for i, w in want.items())


@pytest.mark.parametrize("dim", [8, 64])
def test_vectors_recall_of_pairs_across_lists(spark, dim):
    """Pairs of unlike vectors just over the threshold, counted only where both ends have other home lists."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.97, size=(3000, 1))
    y = c * x + np.sqrt(1 - c**2) * off
    made = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in pq.near_vectors(df, per_list=60).collect()}
    z = np.concatenate([x, y])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    home = pq._nearest(z, pq.Quantiser(z[np.lexsort(z.T[:1])], 100, 8, 16).coarse)  # as the operator fits it
    across = [i for i in range(3000) if home[i] != home[3000 + i]]
    assert len(across) > 100
    assert np.mean([got[i] == got[3000 + i] for i in across]) >= 0.97


def test_vectors_of_several_lengths_and_without_ids(spark):
    made = [(i, [1.0, 0.01 * i]) for i in range(6)] + [(100 + i, [1.0, 0.0, 0.01 * i]) for i in range(5)]
    made += [(None, [1.0, 0.001]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, -1.0]), (60, [0.001, -1.0]), (40, [0.002, -1.0]), (70, []), (71, None), (None, None)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in pq.near_vectors(df).collect())))
    assert got == sorted(map(str, brute_vectors(made)))


def test_vectors_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pq.near_vectors(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq.near_vectors(nulls).collect()}
    assert got == {1: (0, 1, True), None: (2, 2, False), 2: (2, 2, True), 3: (2, 2, False)}
    copies = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(3000)] + [(-1, [-0.0, 1.0]), (5000, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {tuple(r)[1:3] for r in pq.near_vectors(copies).collect() if r.vec_id < 5000}
    assert got == {(3000, -1)}


# --- toxicity against brute force


def brute_viterbi(span, model, spaced):
    """The best of all paths through the lattice."""
    best = None
    for path in product(*toxicity._lattice(span, spaced)):
        a = b = 0
        score = 0.0
        for text, p in path:
            score += p
            for ch in text:
                c = toxicity._CODE.get(ch, 0)
                score += float(model[a, b, c])
                a, b = b, c
        score += float(model[a, b, 0])
        if best is None or score > best[0] + 1e-9:
            best = (score, "".join(t for t, _ in path))
    return best


def path_score(text_and_channel, model):
    a = b = 0
    score = sum(p for _, p in text_and_channel)
    for ch in "".join(t for t, _ in text_and_channel):
        c = toxicity._CODE.get(ch, 0)
        score += float(model[a, b, c])
        a, b = b, c
    return score + float(model[a, b, 0])


def test_viterbi_finds_the_best_path():
    rng = random.Random(6)
    model = np.log(np.random.default_rng(6).dirichlet(np.ones(64) * 0.3, (64, 64)) + 1e-6).astype(np.float32)
    for _ in range(150):
        span = "".join(rng.choice("ab1!$@033*i") for _ in range(rng.randrange(1, 8)))
        want = brute_viterbi(span, model, False)
        got = toxicity.viterbi(span, model, False, window=rng.choice([1, 2, 512]))
        # ties in letters aside, no path scores more
        same = [path_score(p, model) for p in product(*toxicity._lattice(span, False)) if "".join(t for t, _ in p) == got]
        assert abs(max(same) - want[0]) < 1e-4, (span, got, want)
    spaced = "i d1o.t"
    assert abs(brute_viterbi(spaced, model, True)[0] - max(path_score(p, model) for p in product(*toxicity._lattice(spaced, True)) if "".join(t for t, _ in p) == toxicity.viterbi(spaced, model, True))) < 1e-4


def test_long_spans_are_decoded_in_windows():
    model = toxicity.language_model(np.random.default_rng(1).random(64**3) * 9)
    for span in ("a1" * 30_000, "1!" * 30_000, "$3" * 30_000):
        assert len(toxicity.viterbi(span, model)) > 0
    rng = random.Random(2)
    for _ in range(5):
        span = "".join(rng.choice("abcde13$!") for _ in range(3000))
        assert toxicity.viterbi(span, model, window=16) == toxicity.viterbi(span, model, window=10**6)


def test_toxicity_scores_equal_plain_sums(spark, docs):
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((1 << 12) + 1) < 0.3, rng.normal(size=(1 << 12) + 1), 0.0)
    model = toxicity.language_model(toxicity.count_trigrams(docs))
    own = toxicity.Restorer(model)
    for r in toxicity.score_toxicity(docs.limit(60), weights, model).collect():
        at = toxicity._slots([own.restore(r.text)], 12)[1]
        assert len(set(at.tolist())) == len(at)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(weights[-1] + weights[:-1][at].astype(np.float32).sum(), -35, 35)))) < 1e-4
    # features of a small text, counted by hand
    text = "one two two three three three three"
    counts = Counter(w for w in text.split()) + Counter(f"{n}:{w[:n]}" for w in text.split() for n in (4, 5, 6) if len(w) >= n)
    assert len(toxicity._slots([text], 40)[1]) == sum(min(n, 3) for n in counts.values())


def test_quality_scores_equal_plain_sums(spark, docs):
    weights = np.random.default_rng(4).normal(size=(1 << 10) + 1)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, weights).collect()}
    for r in docs.limit(60).collect():
        grams = re.findall(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+", r.text) if r.text.isascii() else None
        slot = quality._slots([r.text], 10)[1]
        if grams is not None:
            assert len(slot) == max(2 * len(grams) - 1, 0)
        want = 1 / (1 + np.exp(-np.clip(weights[-1] + quality.SCALE * weights[:-1][slot].sum() / max(len(slot), 1), -35, 35)))
        assert abs(got[r.doc_id] - want) < 1e-9


def test_long_secrets_and_addresses_are_covered_to_their_end(spark):
    cases = [
        ("x password=" + "a1b2" * 90 + " end", (2, 371, "secret")), ("key ghp_" + "aB3_" * 50 + " end", (4, 208, "secret")), ("my token is " + "z9" * 200, (12, 412, "secret")), ('"' + "0af3" * 40 + '"', (0, 162, "secret")),
        ("write " + "n" * 300 + " at " + "d" * 200 + " dot sub" * 30 + " dot com now", (6, 758, "masked_email")), ("m" * 200 + " (at) host" + " (dot) x" * 20 + " (dot) org z", (0, 380, "masked_email")),
    ]
    for text, want in cases:
        assert [c[:3] for c in pii.candidates(text)] == [want]
    for text in ("a at b" + " dot x" * 40_000, "x (at) " * 40_000, "password=" * 40_000, "a (at) b" + " (dot) c" * 40_000):
        pii.candidates(text)  # linear in the text
    docs = spark.createDataFrame([(i, f"{t} and more") for i, (t, _) in enumerate(cases)] * 5 + [(100 + i, f"mail me at me{i}@host.org or call") for i in range(60)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "a1b2" not in left[0] and "aB3_" not in left[1]


def test_masks_stand_for_letters(spark):
    docs = spark.createDataFrame([("the stupid idiot and the worthless moron this " * 80,), ("plain words of a text that says nothing at all " * 80,)], "text string")
    own = toxicity.Restorer(toxicity.language_model(toxicity.count_trigrams(docs)))
    for told, meant in (("st*pid", "stupid"), ("st**id", "stupid"), ("w%rthl*ss", "worthless"), ("m&r#n", "moron"), ("w0rthl*$s", "worthless"), ("50% of *** c#", "50% of *** c#"), ("pl*in words", "plain words")):
        assert own.restore(told) == meant
    assert own.restore("st****pid") == "stpid"  # a longer row is an ornament


def test_long_streams_that_arrive_out_of_order(spark):
    """Streams over many pieces of sequence numbers, shuffled and dealt to many partitions, against a plain fold."""
    rnd, events = random.Random(12), []
    for conv in range(3):
        for message in range(4):
            start = rnd.randint(0, 5000)
            for step in range(rnd.choice((1, 300, 1100))):
                kind = "delta" if step == 0 else rnd.choices(("delta", "edit", "regenerate", "odd"), (97, 1, 1, 1))[0]
                events.append((conv, message, start + step, ("user", "assistant")[message % 2], kind, f"{step}é "))
    events.append((9, 0, 10, "user", "delta", "gone"))
    events.append((9, 0, 700, "user", "delete", None))
    want = {}
    for conv, message, seq, role, kind, text in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        first, said, r = want.get((conv, message), (seq, "", role))
        said = None if kind == "delete" else text if kind == "edit" else "" if kind == "regenerate" else (said or "") + (text or "")
        want[conv, message] = (first, said, r)
    want = {k: v for k, v in want.items() if v[1] is not None}
    rnd.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, role string, kind string, text string").repartition(9)
    assert {(r.conv_id, r.message): (r.seq, r.text, r.role) for r in chat.fold_events(df).collect()} == want
