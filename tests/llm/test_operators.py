"""Each training-data operator against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataseek.operators import components
from strataseek.llm import chat, common, embed_dedup, language_id, license_scan, packing, pieces, quality, queries, simhash, token_counts, token_files, token_memo, unigram

ODD = ["", " ", "\n\n", "a", "a b", "A  b\tC", "é ß", "\x1c", "<|endoftext|> x", "<|im_end|>", "\\n \\ <\\|", "x" * 5000, "to be " * 400, "İ, ,x", "...", "日本語 テキスト", "😀😀"]


def frame(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def links_to_roots(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.fixture(scope="session")
def vocabulary():
    return unigram.read_vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def library(vocabulary):
    """The tokenizers library's unigram model on the same pieces and scores."""
    from tokenizers import Tokenizer, models

    scored = list(zip(vocabulary.pieces, vocabulary.scores, strict=True))
    return Tokenizer(models.Unigram(scored, unk_id=vocabulary.unknown, byte_fallback=True))


def by_hand(v, text):
    """Best segmentation by plain dynamic programming over the whole text."""
    made = v.prepare(text)
    known = {p: (i, s) for p, i, s in v.matchable()}
    longest = max(map(len, known))
    best = [(0.0, [])] + [None] * len(made)
    for start in range(len(made)):
        score, ids = best[start]
        for end in range(start + 1, min(len(made), start + longest) + 1):
            if (k := known.get(made[start:end])) and (best[end] is None or score + k[1] > best[end][0]):
                best[end] = (score + k[1], ids + [k[0]])
        if made[start] not in known and (best[start + 1] is None or score + v.unknown_score > best[start + 1][0]):
            best[start + 1] = (score + v.unknown_score, ids + [v.byte_id[b] for b in made[start].encode()])
    return best[-1]


def test_unigram_matches_plain_search(spark, tiny, vocabulary, library):
    encoder, counter = pieces.Encoder(vocabulary), token_counts.Counter(vocabulary)
    rng = random.Random(1)
    texts = [t[:1500].replace("\n", " ") if i % 2 else t[:1500] for i, t in enumerate(list(texts_of(spark, tiny).values())[:40])] + ODD
    texts += ["".join(rng.choice("aeht. éß\n▁日x") for _ in range(rng.randrange(30))) for _ in range(200)]
    same = 0
    for t in texts:
        score, ids = by_hand(vocabulary, t)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids
        parts = [counter[x] for x in vocabulary.segments(t)]
        assert sum(x[0] for x in parts) == len(ids)
        assert sum(x[1] for x in parts) == pytest.approx(score)
        if "▁" not in t:
            assert encoder.decode(ids) == t
        if not set(ids) & set(vocabulary.byte_id):
            assert library.encode(vocabulary.prepare(t), add_special_tokens=False).ids == ids
            same += 1
    assert same > 60


def test_unigram_ties():
    v = unigram.Vocabulary(["<unk>", "a", "aa", "aaa", "b", "ab"], [0.0, -1.0, -2.0, -3.0, -1.0, -2.0], [2, 1, 1, 1, 1, 1], add_dummy_prefix=False)
    assert np.frombuffer(pieces.Encoder(v).encode("aaa"), "<u4").tolist() == [3]
    assert token_counts.Counter(v)["aaa"] == (1, -3.0)
    assert token_counts.Counter(v)["ab"] == (1, -2.0)
    assert token_counts.Counter(v)["a?"][1] == -1.0 - 13.0


def test_op1_and_op2(spark, tiny, vocabulary):
    counted = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, tiny).collect()}
    coded = {r.doc_id: r for r in queries.op2_sentencepiece(spark, tiny).collect()}
    assert counted == {k: len(r.ids) for k, r in coded.items()}
    assert all(r.same for r in coded.values())
    back = pieces.decode_pieces(pieces.encode_pieces(frame(spark, ODD + [None]), vocabulary), vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(ODD + [""]))


def plain_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3(spark, sf):
    texts = texts_of(spark, sf)
    want = {k: plain_fingerprint(t) for k, t in texts.items()}
    ids = sorted(want)
    roots = links_to_roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (want[a] ^ want[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in queries.op3_simhash(spark, sf).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in want.items()}
    assert {k: r.component_id for k, r in got.items()} == roots
    assert any(k != v for k, v in roots.items())


def test_simhash_hot_buckets_and_odd_rows(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    distinct = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, node bigint")
    want = links_to_roots(range(len(signed)), [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 2])
    for pairwise in (8, 10_000):
        found = {r.node: r.root for r in components.components(simhash.fingerprint_links(distinct, 2, pairwise)).collect()}
        assert {n: found.get(n, n) for n in want} == want
    for v in range(1, 8):
        assert len(simhash.covering_masks(2)) == 7
    rows = [(None, "a b c", 1), (1, None, 2), (2, "", 3), (3, " \t", 4), (1, None, 2), (9, "q w e r t y", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 9, 9), (True, 0, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001), (1001, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_op4(spark, sf):
    texts = texts_of(spark, sf)
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        r, want = got[k], plain_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sound = [k for k in labels if not got[k].base_failed]
    good = [k for k in sound if labels[k] == 1]
    bad = [k for k in sound if labels[k] == 0]
    assert sum(got[k].kept for k in good) >= 0.97 * len(good)
    assert sum(not got[k].kept for k in bad) >= 0.6 * len(bad)
    odd = quality.judge(frame(spark, ODD + [None]).withColumn("lang", F.lit(None).cast("string")).withColumn("kept", F.lit(1))).collect()
    for r in odd:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality((ODD + [None])[r.doc_id])
    assert quality.judge(frame(spark, ["x"]).limit(0)).count() == 0


def plain_vectors(rows, least=0.98):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, v, lab) in enumerate(ok):
        for j, w, lab2 in ok[:n]:
            if lab == lab2 and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links.append((i, j))
    return Counter(x for p in links for x in p), links_to_roots([r[0] for r in rows], links)


def test_op5(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    # a dense group in one label, near the threshold, beside exact copies and odd vectors
    rows += [(10_000 + i, (centre + rng.standard_normal(64) * 0.13).tolist(), 3) for i in range(300)]
    rows += [(20_000 + i, centre.tolist(), 3) for i in range(5)] + [(20_010, (2 * centre).tolist(), 3), (20_011, centre.tolist(), 4)]
    rows += [(30_000, [0.0] * 64, 3), (30_001, None, 3), (30_002, [float("nan")] * 64, 3), (30_003, centre.tolist(), None), (30_004, [], 3), (30_005, [1.0, 0.0], 3), (30_006, [1.0, 0.01], 3)]
    n_links, roots = plain_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for tile in (embed_dedup.TILE, 64):
        got = {r.vec_id: r for r in embed_dedup.near_vectors(df, tile=tile).collect()}
        assert len(got) == len(rows)
        assert {k: r.n_links for k, r in got.items()} == {r[0]: n_links[r[0]] for r in rows}
        assert {k: r.component_id for k, r in got.items()} == roots
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def plain_licenses(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(i, lab) for p, lab in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_op6(spark, sf):
    texts = texts_of(spark, sf)
    got = {r.doc_id: r for r in queries.op6_license_scan(spark, sf).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    mit = license_scan.NOTICES["mit-text"].split()
    changed = " ".join(mit[:20] + ["indeed"] + mit[20:40] + mit[42:])
    odd = ["MIT License, mit license cc by cc by", f"intro words {changed} tail", "GNU general public", None, "", "mit " * 300, "apache license"] + ODD
    rows = {r.doc_id: r for r in license_scan.scan(frame(spark, odd)).collect()}
    for k, t in enumerate(odd):
        assert (rows[k].n_words, rows[k].n_base, rows[k].first_word, rows[k].last_word, rows[k].base_labels) == plain_licenses(t)
    assert rows[1].labels == "mit-text" and 0.6 <= rows[1].score < 1 and rows[1].spans[0].first == 2
    assert license_scan.scan(frame(spark, odd).union(frame(spark, odd))).count() == 2 * len(odd)


def test_op7(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out and r.lang_pred != "und"]
    assert sum(got[k].lang_pred == langs[k] for k in held) >= 0.97 * len(held)
    odd = {r.doc_id: r for r in language_id.identify(frame(spark, ODD + [None]), language_id.ByteNet(["de", "en"])).collect()}
    assert {k for k, r in odd.items() if r.lang_pred == "und"} == {i for i, t in enumerate(ODD + [None]) if not any(map(str.isalpha, t or ""))}
    assert {r.lang_pred for r in language_id.identify(frame(spark, ["abc"]), language_id.train(frame(spark, ["x"]).limit(0))).collect()} == {"und"}


def test_byte_net_lookup_is_the_convolution():
    net = language_id.ByteNet(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    h = []
    for w in language_id.WIDTHS:
        conv = sum(net.p["e"][x][:, k : language_id.WINDOW - w + 1 + k] @ net.p[f"w{w}"][k] for k in range(w)) + net.p[f"b{w}"]
        h.append(conv.max(1))
    z = np.maximum(np.concatenate(h, 1), 0) @ net.p["o"] + net.p["c"]
    q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(net.predict(x), q, atol=1e-4)


def encode_all(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_memo(spark, tiny, name):
    memo = token_memo.TokenMemo(token_memo.read_spec(queries.tokenizer_path(name)))
    rng = random.Random(2)
    texts = ODD + list(texts_of(spark, tiny).values())
    texts += ["".join(rng.choice("aB é.,'\n\t!1  _\x1c ß́İΣ<|s") for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|>y", "<| endoftext |>", "q" * 70 + " " + "w" * 300, ".a", ",", " ."]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids_of(texts)] == encode_all(name, texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_memo_looks_up_distinct_pieces(name):
    class Counted(dict):
        looked = 0

        def get(self, key):
            self.looked += 1
            return super().get(key)

    memo = token_memo.TokenMemo(token_memo.read_spec(queries.tokenizer_path(name)))
    memo.pieces = Counted()
    texts = ["one two, three words. " * 50 + "end", "", "two words, one", "one  two\tthree ***"] * 20
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids_of(texts)] == encode_all(name, texts)
    assert memo.pieces.looked < 30 < len(texts)


def best_fit(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(window - n)
    return sorted(room)


def test_packing_plan_is_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        window = rng.choice([7, 16, 50, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randrange(100))]
        used = defaultdict(list)
        runs = defaultdict(list)
        for run in packing.plan(Counter(lengths), window):
            runs[run[0]].append(run)
        for n, c in Counter(lengths).items():
            for rank in range(c):
                _, first, seq, each, offset = [r for r in runs[n] if r[1] <= rank][-1]
                used[seq + (rank - first) // each].append((offset + (rank - first) % each * n, n))
        for parts in used.values():
            end = 0
            for offset, n in sorted(parts):
                assert offset == end
                end += n
        assert sorted(window - sum(n for _, n in p) for p in used.values()) == best_fit(lengths, window)


def test_op8(spark, sf):
    texts = texts_of(spark, sf)
    ids = {k: x + [1] for k, x in zip(texts, encode_all("word_bpe_49k.json", texts.values()), strict=True)}
    got = queries.op8_packing(spark, sf).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts, total in [*((docs[k], len(v)) for k, v in ids.items()), *((v, None) for v in seqs.values())]:
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        assert end == total or total is None and end <= 2048
    lengths = [r.length for r in got]
    assert sorted(2048 - sum(n for _, n in v) for v in seqs.values()) == best_fit(lengths, 2048)
    spec = token_memo.read_spec(queries.tokenizer_path("word_bpe_49k.json"))
    odd = packing.pack(frame(spark, ODD + [None]), spec).collect()
    assert Counter(r.doc_id for r in odd) == Counter({i: -(-(len(x) + 1) // 2048) for i, x in enumerate(encode_all("word_bpe_49k.json", ODD + [None]))})
    assert packing.pack(frame(spark, ODD).limit(0), spec).count() == 0


def test_op9(spark, sf):
    got = {r.conv_id: r for r in queries.op9_chat(spark, sf).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == set(turns)
    for k, v in turns.items():
        v.sort()
        loss = "".join(t for _, r, t in v if r == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(v), sha("".join(f"{r}\n{t}\n" for _, r, t in v)), len(loss), sha(loss))


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "", None, "a\nb", "\\n", "\\\nx<|im_start|>", "system"]
    rows = [(i % 5 if i % 7 else None, i // 5, roles[i % len(roles)], t) for i, t in enumerate([*ODD, None, "\\", "<|", "<\\|", "<|im_start|>user\nx<|im_end|>\n", "$1 \\$1", "a\\"])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    made = chat.format_chats(df)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_chats(made).collect()}
    want = defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want[c].append((role or "", text or ""))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    flow = [(1, i, r, "x") for i, r in enumerate(["system", "user", "assistant"])] + [(2, i, r, "x") for i, r in enumerate(["user", "user"])] + [(3, 0, "assistant", "x")] + [(4, i, r, "x") for i, r in enumerate(["user", "assistant", "user"])]
    valid = {r.conv_id: r.valid for r in chat.format_chats(spark.createDataFrame(flow, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 127, 128, 129, 5000):
        for ids in (rng.integers(0, 50_000, n), rng.integers(0, 8, n), np.where(rng.random(n) < 0.05, 2**32 - 1, rng.integers(5, 6, n)), np.full(n, 7), rng.integers(0, 2**32, n)):
            ids = ids.astype(np.uint32)
            starts, data = token_files.encode_blocks(ids)
            assert (token_files.decode_blocks(starts, data, n) == ids).all()
            docs, lengths, back = token_files.read_file(token_files.file_bytes([3, None][: min(n, 2)], np.array([n, 0][: min(n, 2)]), ids))
            assert docs == [3, None][: min(n, 2)] and (back == ids).all()
            if n > 300:  # any block alone
                assert (token_files.decode_blocks(starts[2:3], data, 128) == ids[256:384]).all()


def test_op10(spark, sf):
    texts = texts_of(spark, sf)
    got = sorted(queries.op10_token_files(spark, sf).collect())
    at = 0
    for r, (k, x) in zip(got, sorted(zip(texts, encode_all("byte_bpe_50k.json", texts.values()), strict=True)), strict=True):
        raw = np.array(x + [2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(raw) // 4, zlib.crc32(raw))
        at += r.n_tokens
    spec = token_memo.read_spec(queries.tokenizer_path("byte_bpe_50k.json"))
    odd = frame(spark, ODD + [None])
    odd = odd.union(odd.limit(2)).union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    folder = token_files.write_token_files(odd, spec, common.new_dir(spark, "t"), file_ids=2000)
    back = token_files.read_token_files(spark, folder, keep_ids=True).orderBy("start").collect()
    plain = {r.doc_id: r.text for r in odd.collect()}
    for r, ids in zip(back, encode_all("byte_bpe_50k.json", [plain[r.doc_id] for r in back]), strict=True):
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*ids, 2]
    assert [r.doc_id for r in back] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is not None, x))
    assert token_files.token_files(odd.limit(0), spec).count() == 0


def test_clashing_columns(spark):
    df = frame(spark, ["a b c d e f", None]).withColumn("row", F.lit(1)).withColumn("fp", F.lit("x"))
    twice = df.select("*", F.lit("other").alias("TEXT"))
    assert {r.text for r in common.pick(twice, text="string").collect()} == {"a b c d e f", None}
    assert license_scan.scan(twice).count() == 2 and simhash.near_duplicates(twice).count() == 2


def odd_documents(spark):
    """Nulls in each column, empty and very long texts, repeats and names that operators use."""
    long = " ".join(f"word{i % 900} of the" for i in range(40_000))
    rows = [(None, None, None, None), (1, "", "en", "s"), (2, long, None, "s"), (2, long, None, "s"), (3, "x" * 200_000, "en", None), (4, "the mit license of a text", "en", "s"), (None, "a b c", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(["DOC_ID", "row", "fp", "ids", "n_tokens", "score", "shard", "rank", "length", "start", "_c0", "n_words", "kept", "component_id", "lang_pred", "held_out", "valid"])], "text as TEXT")


def runs(vocabulary):
    words, spec = token_memo.read_spec(queries.tokenizer_path("word_bpe_49k.json")), token_memo.read_spec(queries.tokenizer_path("byte_bpe_50k.json"))
    return {
        1: lambda d: token_counts.count_tokens(d, vocabulary), 2: lambda d: pieces.round_trip(d, vocabulary), 3: simhash.near_duplicates, 4: quality.judge, 6: license_scan.scan,
        7: lambda d: language_id.identify(d, language_id.train(d)), 8: lambda d: packing.pack(d, words), 10: lambda d: token_files.token_files(d, spec),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 8, 10])
def test_odd_tables(spark, vocabulary, n):
    df, run = odd_documents(spark), runs(vocabulary)[n]
    got = run(df).collect()
    ids = sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))
    if n == 8:
        assert {r.doc_id for r in got} == set(ids) and sum(r.length for r in got) == sum({(r.doc_id, r.doc_tokens, r.ids_crc32): r.doc_tokens for r in got if r.start == 0 and r.doc_id is not None and r.doc_id != 2}.values()) + 2 * max(r.doc_tokens for r in got if r.doc_id == 2) + sum(r.doc_tokens for r in got if r.doc_id is None)
    else:
        assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ids
    if n == 2:
        assert all(r.same for r in got)
    if n == 3:
        assert {r.component_id for r in got if r.doc_id == 2} == {2}
    if n == 6:
        assert [r.labels for r in got if r.doc_id == 4] == ["mit"]
    assert run(df.limit(0)).count() == 0


def test_odd_vectors_and_chats(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1), (3, [0.0, -1.0], 1), (None, [1.0, 0.0], 1), (4, [-0.0, 1.0], 1)], "vec_id long, embedding array<double>, label long")
    v = v.selectExpr("*", "0 as node", "1 as rep", "2 as VEC_ID", "3 as copies", "4 as k1", "5 as usable")
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id) for r in embed_dedup.near_vectors(v).collect())
    # vec_id 1 stands twice, with a vector near 2's and with one equal to 4's
    assert got == [(False, 0, 0, None), (True, 1, 1, 1), (True, 1, 1, 1), (True, 2, 1, 1), (True, 3, 0, 3), (True, 4, 1, 1)]
    c = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1200)] + [(2, 0, None, None), (None, None, "user", "")], "conv_id long, turn long, role string, text string")
    c = c.selectExpr("*", "1 as turns", "2 as taken", "3 as ROLE", "4 as valid", "5 as segments")
    made = chat.format_chats(c)
    out = {r.conv_id: r for r in chat.digests(chat.read_chats(made)).collect()}
    assert (out[1].valid, out[1].n_turns, out[2].valid, out[None].n_turns) == (True, 1200, False, 1)
    assert out[1].loss_chars == sum(len(f"t{i}") for i in range(1, 1200, 2))
    assert chat.digests(chat.read_chats(chat.format_chats(c.limit(0)))).count() == 0
    plan = chat.digests(chat.read_chats(made))._jdf.queryExecution().optimizedPlan().toString()
    assert "taken" in plan and "aggregate" in plan.lower()


def test_vocabularies_are_told_apart():
    def v(score):
        return unigram.Vocabulary(["<unk>", "a", "b", "ab"], [0.0, -1.0, -1.0, score], [2, 1, 1, 1], add_dummy_prefix=False)

    for score, ids in ((-1.5, [3]), (-3.0, [1, 2])):
        assert np.frombuffer(pieces.encoder_of(v(score), v(score).digest()).encode("ab"), "<u4").tolist() == ids
        assert token_counts.counter_of(v(score), v(score).digest())["ab"][0] == len(ids)


def plain_labels(text):
    """Labels by comparing words alone: diagonals of equal 4-word windows, merged where one
    goes on after the other, verified by the common words of span and template."""
    words = plain_words(text)
    out = set()
    for label, notice in license_scan.NOTICES.items():
        t = plain_words(notice)
        at = defaultdict(list)
        for i in range(len(words) - 3):
            for j in range(len(t) - 3):
                if words[i : i + 4] == t[j : j + 4]:
                    at[i - j].append(i)
        found = []
        for d, places in sorted(at.items(), key=lambda x: (min(x[1]), x[0])):
            for chain in reversed(found):
                e, before = chain[-1]
                if abs(d - e) <= license_scan.DRIFT and min(places) > max(before) and min(places) - d > max(before) - e:
                    chain.append((d, places))
                    break
            else:
                found.append([(d, places)])
        for chain in found:
            n, i0, i1 = sum(len(p) for _, p in chain), min(chain[0][1]), max(max(p) for _, p in chain)
            lo, hi = max(0, chain[0][0]), i1 + len(t) - (max(chain[-1][1]) - chain[-1][0])
            if min(n / (len(t) - 3), n / (i1 - i0 + 1)) >= 0.6 and common_share(words[lo:hi], t) >= 0.8:
                out.add(label)
    return out


def plain_words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def common_share(a, b):
    best = {}
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            here = [best.get((i + 1, j), (0, 0, 0)), best.get((i, j + 1), (0, 0, 0))]
            if a[i] == b[j]:
                n, _, last = best.get((i + 1, j + 1), (0, 0, 0))
                here.append((n + 1, i, last or i))
            best[i, j] = max(here, key=lambda x: x[0])
    n, first, last = best.get((0, 0), (0, 0, 0))
    return n / max(len(b), last - first + 1)


def test_license_labels(spark, sf):
    texts = texts_of(spark, sf)
    rng = random.Random(9)
    made = []
    for label, notice in license_scan.NOTICES.items():
        w = plain_words(notice)
        made += [notice, f"x {notice} y", f"{notice} {notice} between {notice}", " ".join(w[: len(w) // 2]), " ".join(rng.sample(w, len(w)))]
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(v))
                v[i : i + rng.randrange(2)] = ["other"] * rng.randrange(3)
            made.append(" ".join(["a", "b", *v, *w, *v]))
    texts |= {100_000 + i: t for i, t in enumerate(made)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for k, t in texts.items():
        assert set(filter(None, got[k].labels.split(","))) == plain_labels(t) | set(filter(None, plain_licenses(t)[4].split(",")))
        words = plain_words(t)
        for x in got[k].spans:
            assert common_share(words[x.first : x.last + 1], plain_words(license_scan.NOTICES[x.label])) >= 0.8


def test_license_copies_in_a_row(spark):
    notice = license_scan.NOTICES["mit-notice"]
    texts = [" ".join([notice] * n) for n in (1, 2, 3, 40)]
    rows = {r.doc_id: r for r in license_scan.scan(frame(spark, texts)).collect()}
    for k, n in enumerate((1, 2, 3, 40)):
        assert rows[k].labels == "mit,mit-notice" and rows[k].n_base == n
        assert [(x.label, x.first, x.last, x.share) for x in rows[k].spans] == [("mit-notice", 5 * i, 5 * i + 4, 1.0) for i in range(n)]
