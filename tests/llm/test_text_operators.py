"""Token files, language, chat, secrets, quality, decontamination and mixing."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import chat, common, decontam, language, mixing, quality, secret_scan, token_store, trigrams

# ---- token files ----------------------------------------------------------------


def brute_tokens(rows):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(token_store.default_tokenizer()).encode
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_tokens(which, request):
    frame = request.getfixturevalue(which)
    got = [tuple(r) for r in token_store.round_trip(frame).collect()]
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert sorted(got, key=repr) == sorted(brute_tokens(rows), key=repr)


def test_pieces_equal_whole_texts():
    encoder = token_store.Encoder(token_store.default_tokenizer())
    texts = ["", "a  b", " a", "a ", "a\n b", "a \n b\n\nc", "x<|endoftext|>y <|endoftext|> z", "don't we'll ab'sx",
             "é̃ áb ñ1 １２ a b 　c", "a\tb \tc", "  \n  ", "tab\x1cq r\x85s t᠎u",
             "中文 字 words", "end.\nThe next", "a\n\nb c\n d", " ́a b́ ", "x\r\ny z\r\n", "A!! B%%% |", "a" * 5000]
    assert encoder.by_piece
    for _ in range(2):
        assert encoder.encode(texts) == encoder._ids(texts)


def test_pieces_of_random_texts_with_a_small_memory():
    encoder = token_store.Encoder(token_store.default_tokenizer(), most=40)
    encoder.RUNS, encoder.words.SHORT = 7, 12
    draw = random.Random(5)
    signs = [*"abzAZéñßÀɏ", *"aeiou" * 3, *" " * 9, *"\n\t\r.,'!-<|>[]`~09", "'s", "'re", " ́", "中", "я", "١", "\x00",
             "\xa0", "　", "<|endoftext|>", " the", " and", ".\nThe", " \n", "😀"]
    for _ in range(60):
        texts = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(draw.randrange(12))]
        assert encoder.encode(texts) == encoder._ids(texts)
        assert len(encoder.parts) < 400 and len(encoder.words.strings) < 400


def test_letters_of_new_words_are_merged_once_and_together():
    encoder = token_store.Encoder(token_store.default_tokenizer())
    asked = []

    class Counting:
        def encode_batch_fast(self, batch, **how):
            asked.append([run for runs in batch for run in runs])
            return merges.encode_batch_fast(batch, **how)

    merges, encoder.merges = encoder.merges, Counting()
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=9)) for _ in range(3000)]
    texts = ["- " + " ".join(w + end for w in words) for end in ("", ".", "!?", ",")]
    for _ in range(2):
        assert encoder.encode(texts) == encoder._ids(texts)
    assert encoder.encode([texts[1] + " - more"]) == encoder._ids([texts[1] + " - more"])
    assert sorted(r for runs in asked for r in runs) == sorted({" " + w for w in words} | {" more"})
    assert len(asked) == 2


def test_only_asked_frames_are_read(spark, documents, monkeypatch):
    folder = common.shared_folder(spark, "tok")
    manifest = token_store.write_tokens(documents, token_store.default_tokenizer(), folder)
    wanted = [0, 17, 199, 10**9]
    some = token_store.read_tokens(manifest, wanted, ids=True).collect()
    every = {r["doc_id"]: r for r in token_store.read_tokens(manifest).collect()}
    assert sorted(r["doc_id"] for r in some) == [0, 17, 199]
    for r in some:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == tuple(every[r["doc_id"]])[1:]
        assert len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0
    shard = token_store.ShardReader(manifest.first()["path"])
    seen = []
    unpack = shard.unpack
    shard.unpack = lambda data: seen.append(1) or unpack(data)
    shard.tokens(int(shard.find([shard.ids[3]])[0]))
    assert len(seen) == 1


def test_damage_is_found(tmp_path):
    path = str(tmp_path / "x.tok")
    writer = token_store.ShardWriter(path, 2, 0)
    for k in range(5):
        writer.add(k if k else None, np.arange(k, dtype="<u2").tobytes())
    writer.close()
    reader = token_store.ShardReader(path)
    assert [reader.tokens(k).tolist() for k in range(5)] == [list(range(k)) for k in range(5)]
    assert reader.find([0, 3]).tolist() == [3] and reader.offsets().tolist() == [0, 0, 1, 3, 6, 10]
    data = bytearray((tmp_path / "x.tok").read_bytes())
    import zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) == 20
    data[int(reader.starts[4]) + int(reader.entries["packed"][4]) - 3] ^= 255
    (tmp_path / "y.tok").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_store.ShardReader(str(tmp_path / "y.tok")).tokens(4)


# ---- language -----------------------------------------------------------------


def test_automaton_finds_exactly_the_substrings():
    text = "abracadabra abab"
    table = language.automaton(np.array([ord(c) - 32 for c in text]), 128)

    def known(s):
        state = 1
        for c in s:
            state = table[state, ord(c) - 32]
            if not state:
                return False
        return True

    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(map(known, parts))
    assert not any(known(s) for s in ("ba b", "rr", "abracadabrb", "z"))


def greedy(sample, text):
    """Phrases of one text, character by character."""
    count, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at:end + 1] in sample:
            end += 1
        count, at = count + 1, end + 1
    return count


def test_phrases_equal_a_greedy_parse():
    rows = [("en", "the cat sat on the mat and the dog"), ("fr", "le chat est sur la table et le chien")]
    model = language.Model(rows)
    text = "the chat sat sur the table zq"
    want = [greedy(sample, text) for _, sample in rows]
    assert model.phrases([model.coded(text)])[0].tolist() == want
    assert model.coded("  A--b!!c ").tolist() == model.coded("a b c").tolist()


def test_language(spark, documents, odd, empty):
    got = language.predict(documents)
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in got.collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    some = collections.defaultdict(list)
    for r in language.predict(odd).collect():
        some[r["doc_id"]].append(r["lang_pred"])
    assert some[3] == some[4] == some[5] == ["und"] and some[6] == ["en"] and len(some[2]) == 2
    assert language.predict(empty).count() == 0
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict(unlabelled).collect()} == {"und"}


# ---- chat ---------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|a|>", "<\\\\|b", "x<|y<|", "\\<|", "<", "|", "a\nb"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "<|" not in chat.escape(text) and "\n" not in chat.escape_role(text)


def test_parts_become_placeholders(spark):
    part = lambda kind, **of: {"type": kind, **of}
    rows = [(1, 0, "user", [part("text", text="look <|"), part("image", ref="s3://i", width=56, height=29),
                            part("audio", ref="s3://a", seconds=2.0), part("document", ref="d", pages=3)]),
            (1, 1, "assistant", [part("text", text="one"), part("image", ref="r"), part("text", text="two")]),
            (1, 2, None, None)]
    kinds = chat.PART
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{kinds}>")
    first, second, third = chat.format_turns(frame).orderBy("turn").collect()
    assert first["segment"] == "<|im_start|>user\nlook <\\|<|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        ("image", "s3://i", 4), ("audio", "s3://a", 25), ("document", "d", 768)]
    assert first["attached_tokens"] == 797 and not first["loss"]
    assert all(first["segment"][a["position"]:].startswith("<|") for a in first["attachments"])
    assert [second["segment"][s["begin"]:s["stop"]] for s in second["loss"]] == ["one", "two"]
    assert third["segment"] == "<|im_start|>\n<|im_end|>\n"


def test_chat_odd(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", None), (1, 2, "assistant", "é\U0001f600"), (1, 1, None, "b"),
            (1, 2, "assistant", "é\U0001f600"), (2, 0, "a\nb", "t" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn(
        "segment", F.lit(1)).withColumn("loss", F.lit(2))
    got = {r["conv_id"]: r for r in chat.format_and_read(frame).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\n" + "\nb\n" + "assistant\né\U0001f600\n" * 2)
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, 4, sha("é\U0001f600" * 2))
    assert got[2]["turns_sha256"] == sha("a\nb\n" + "t" * 200_000 + "\n") and got[None]["n_turns"] == 1
    assert chat.format_and_read(frame.limit(0)).count() == 0


# ---- secrets -------------------------------------------------------------------


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_trigram_queries_hold(rule):
    """Each example that matches meets the query."""
    examples = {
        "assign": ["password = 'abcdef1'", "API_KEY:zzzzzz", "apikey=123456", "xToKeN=abc.def", "secret=abcdefg"],
        "access": ["AKIA" + "B" * 16], "hex": ["0123456789abcdef01234567"], "pem": ["-----BEGIN RSA PRIVATE KEY-----"],
        "github": ["ghp_" + "a" * 36, "gho_" + "a" * 40], "slack": ["xoxb-1234567890", "xoxs-abcdefghijk"],
        "jwt": ["eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh1"], "google": ["AIza" + "c" * 35],
    }[rule.kind]
    query = trigrams.query(rule.pattern, rule.folds)
    for text in examples:
        assert re.search(rule.pattern, text)
        seen = text.lower() if rule.folds else text
        assert query is None or any(all(t in seen for t in c) for c in query)
    assert (query is None) == (rule.kind == "hex")


def brute_secrets(text):
    text, out = text or "", []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{secret_scan.RULES[k].kind}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets(spark, odd, empty, documents):
    hard = ["secret: token: abcdefgh", "password=ab token=token=abcdefgh", "é😀 passwd='longenough' AKIA" + "Z9" * 9,
            "AKIAAKIA" + "Q" * 12, "AKIA" + "Q" * 10 + " AKIA" + "Q" * 16, "a" * 23 + " " + "b" * 30 + "g" + "c" * 24,
            "api_key\"  := \"x\" apikey: ABCDEF", "ghp_" + "a" * 40 + " xoxb-1234567890-x eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh1",
            "PASSWORD=\"abcdef" * 3, "-----BEGIN EC PRIVATE KEY-----\n", "toKen=ſſabcdefg"]
    frame = spark.createDataFrame([helpers.row(k, t) for k, t in enumerate(hard)], helpers.SCHEMA)
    for table in (odd, frame, documents, empty):
        got = sorted((repr(r["doc_id"]), r["spans"]) for r in secret_scan.report(table).collect())
        assert got == sorted((repr(r["doc_id"]), brute_secrets(r["text"])) for r in table.collect())


def test_many_secrets_in_one_text(spark):
    """Positions past many blocks, and work in proportion to the matches of a text."""
    runs = " ".join(f"{k:024x} é token={k:07d}" for k in range(50_000))
    frame = spark.createDataFrame([helpers.row(1, runs), helpers.row(2, "b" * 24)], helpers.SCHEMA)
    start = time.monotonic()
    got = {r["doc_id"]: r for r in secret_scan.report(frame).collect()}
    assert time.monotonic() - start < 60
    assert got[1]["n_hex"] == got[1]["n_assign"] == 50_000
    assert got[1]["spans"] == brute_secrets(runs) and got[2]["spans"] == "hex:0:24"


def test_secret_scan_is_native(documents):
    plan = secret_scan.report(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- quality ------------------------------------------------------------------


def test_quality(spark, sf, odd, empty):
    big = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.classify(documents, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [(truth[d], r["predicted"]) for d, r in got.items() if r["held_out"] and d in truth]
    assert np.mean([a == b for a, b in out]) >= 0.97
    assert len(got) == documents.count()
    weights = quality.learn(documents, labels)
    scored = quality.score(odd, weights, ["doc_id"]).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.keep_good(empty, labels).columns == empty.columns
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    odd_labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, None), (2, 0, 0)],
                                       "doc_id bigint, quality int, toxic int")
    assert quality.classify(odd, odd_labels).count() == odd.count()


def test_feature_values():
    owner, feature, value = quality.features([b"a b a b", b"", b"WORD!! WORD!!"], quality.Words())
    assert set(owner.tolist()) == {0, 2}
    assert quality.shape(b"WORDword12!!") == b"Aa0!" and len(feature) == len(value)
    # The shares of the single words of a text add up to one.
    assert value[owner == 0][:2].tolist() == pytest.approx([0.5**0.5] * 2)


# ---- decontamination ------------------------------------------------------------


def test_walk_of_equal_sequences_is_equal():
    random = np.random.default_rng(2)
    a = random.integers(1, 1 << 62, (5, 20), np.uint64)
    places, seeds = decontam.plan(20, 7)
    assert (decontam.walk(a, places, seeds) == decontam.walk(a.copy(), places, seeds)).all()
    other = decontam.walk(random.integers(1, 1 << 62, (5, 20), np.uint64), places, seeds)
    keys = decontam.walk(a, places, seeds)
    assert not ((keys == other) & (keys != 0)).any() and (keys != 0).mean() > 0.5


def test_distances():
    random = np.random.default_rng(3)
    a, b = random.integers(1, 4, (60, 9), np.uint64), random.integers(1, 4, (60, 9), np.uint64)
    lengths = random.integers(1, 10, 60)
    for k, n in enumerate(lengths):
        a[k, n:] = 0
    want = [helpers.edits(x[:n].tolist(), y.tolist()) for x, y, n in zip(a, b, lengths, strict=True)]
    assert decontam.distances(a, b, lengths).tolist() == want


def brute_leaks(text, items):
    forms = decontam.Forms()
    flat, _ = decontam.word_forms([(text or "").encode()], forms)
    flat, found = flat.tolist(), set()
    for i, t in items:
        item = decontam.word_forms([(t or "").encode()], forms)[0].tolist()
        if len(item) >= decontam.LEAST:
            most = int(decontam.RATE * len(item))
            if any(edits <= most for edits in (helpers.edits(flat[s:s + len(item)], item) for s in range(len(flat)))):
                found.add(i)
    return found


def test_leaks(spark, sf, odd, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    random, rows = np.random.default_rng(5), []
    for k in range(150):
        words = items[k % len(items)][1].split()
        for _ in range(int(random.integers(0, int(0.25 * len(words)) + 1))):
            p = int(random.integers(len(words)))
            words[p:p + int(random.integers(2))] = ["Edited,"] * int(random.integers(2))
        rows.append(helpers.row(k, " ".join(["left"] * int(random.integers(9)) + words + ["right!"] * int(random.integers(9)))))
    frame = spark.createDataFrame(rows, helpers.SCHEMA)
    benchmark = spark.createDataFrame([*items, (None, "four words are few"), (None, None), (900, "")],
                                      "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, benchmark).collect()}
    want = {(r[0], i) for r in rows for i in brute_leaks(r[1], items)}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 90
    clean = decontam.decontaminate(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    assert decontam.decontaminate(odd, benchmark).count() == odd.count()
    assert decontam.contaminated(empty, benchmark).count() == 0
    assert decontam.contaminated(odd, benchmark.limit(0)).count() == 0


def test_recall_of_each_length():
    """Long items among many short ones: windows at the largest distance share a key, and are found in documents."""
    random, items = np.random.default_rng(8), []
    for n, count in ((9, 600), (150, 8), (300, 8)):
        items += [(1000 * n + k, random.integers(1, 1 << 62, n, np.uint64)) for k in range(count)]
    index = decontam.Index(items)
    for n, found in index.by_length.items():
        windows, of = [], np.resize(np.arange(len(found)), 600)
        for k in of:
            words = items[found[k]][1].copy()
            words[random.choice(n, int(decontam.RATE * n), replace=False)] = random.integers(
                1, 1 << 62, int(decontam.RATE * n), np.uint64)
            windows.append(words)
        window, place = index.buckets[n].lookup(np.stack(windows))
        met = set(zip(window.tolist(), place.tolist(), strict=True))
        assert np.mean([(k, int(p)) in met for k, p in enumerate(of)]) >= 0.97, n
        hits = 0
        for k in range(40):
            around = random.integers(1, 1 << 62, 30, np.uint64)
            flat = np.concatenate([around[:17], windows[k], around[17:]])
            for document, item, start, distance in index.matches(flat, np.array([0, len(flat)])):
                most, hits = int(decontam.RATE * n), hits + 1
                assert (document, item) == (0, items[found[of[k]]][0])
                assert distance <= most and abs(start - 17) <= most
        assert hits >= 39, n


def test_short_items_are_found_whole(spark, empty):
    """Items of one to four words, alone and beside long ones; scripts without spaces are one word."""
    items = [(1, "alpha beta"), (2, "Gamma!"), (3, "one two three four"), (4, "这是一个基准问题的完整文本"), (5, "!!"), (6, None)]
    long = [(7, "a long item of seven plain words"), (8, "alpha beta")]
    texts = ["x alpha beta y", "alpha", "beta alpha", "say gamma, twice gamma", "one two three", "one two three four",
             "这是一个基准问题的完整文本", "a long item with seven plain words", None, "", "ALPHA, beta"]
    frame = spark.createDataFrame([helpers.row(k, t) for k, t in enumerate(texts)], helpers.SCHEMA)
    short_only = {(0, 1, 1, 2), (3, 2, 1, 1), (5, 3, 0, 4), (6, 4, 0, 1), (10, 1, 0, 2)}
    both = short_only | {(0, 8, 1, 2), (10, 8, 0, 2), (7, 7, 0, 7)}
    for rows, want in ((items, short_only), (items + long, both)):
        benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
        found = decontam.contaminated(frame, benchmark)
        assert {(r["doc_id"], r["item_id"], r["start"], r["n_words"]) for r in found.collect()} == want
        left = {r["doc_id"] for r in decontam.decontaminate(frame, benchmark).collect()}
        assert left == set(range(len(texts))) - {d for d, *_ in want}
        assert decontam.contaminated(empty, benchmark).count() == 0


def test_windows_have_candidates_of_their_bucket_only():
    """Among 50,000 items of one length a window meets its own and few others."""
    random = np.random.default_rng(11)
    words = random.integers(1, 1 << 62, (50_000, 12), np.uint64)
    buckets = decontam.Buckets(np.arange(len(words)), words, 12)
    windows = words[:400].copy()
    windows[np.arange(400), random.integers(12, size=400)] = 5
    window, place = buckets.lookup(windows)
    assert np.mean([k in place[window == k] for k in range(400)]) >= 0.97
    assert len(window) < 800


# ---- mixing --------------------------------------------------------------------


def fill(sizes, weights, most=3.0):
    """Water filling round by round."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        level = rest / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weights[s] * level for s in sizes}
        capped |= over


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_mixing(which, request):
    frame = request.getfixturevalue(which)
    rows = mixing.mix_counts(frame).collect()
    source = collections.defaultdict(list)
    for r in rows:
        source[r["source"]].append(r)
    order = sorted(source, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(helpers.words(r["text"])) for r in source[s]) for s in order}
    targets = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for s in order:
        largest = max(r["size"] for r in source[s])
        assert {r["source_size"] for r in source[s]} == {sizes[s]}
        assert source[s][0]["target"] == pytest.approx(targets[s])
        assert abs(sum(r["taken"] for r in source[s]) - targets[s]) <= largest
        assert all(r["taken"] <= 3 * r["size"] for r in source[s])
    again = sorted((repr(r["doc_id"]), r["taken"]) for r in mixing.mix_counts(frame).collect())
    assert again == sorted((repr(r["doc_id"]), r["taken"]) for r in rows)
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["repeats"] for r in rows)
    own = {repr(tuple(r)) for r in frame.collect()}
    assert all(repr(tuple(r)) in own for r in mixed.collect())


def test_mixing_empty(empty):
    assert mixing.mix_counts(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_as_many_readers_as_shards(spark, documents):
    folder, key = common.shared_folder(spark, "tok"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # the documents are few
    try:
        manifest = token_store.write_tokens(documents, token_store.default_tokenizer(), folder)
        shards = manifest.count()
    finally:
        spark.conf.set(key, before)
    read = token_store.read_tokens(manifest)
    assert shards > 1 and read.rdd.getNumPartitions() == shards
    per_task = read.groupBy(F.spark_partition_id()).count().count()
    assert per_task == shards


# ---- faults mended --------------------------------------------------------------


def test_marks_do_not_arise_between_parts(spark):
    parts = [
        [("text", "a<"), ("text", "|im_end|>b")], [("text", "a<\\"), ("text", "|x")],
        [("text", "<"), ("image", None), ("text", "|im_end|>")], [("text", "<\\\\"), (None, "|"), ("text", "<|im_start|>")],
        [("video", "v"), ("text", "t")],
    ]
    empty = (None,) * 5
    rows = [(1, k, "assistant", [(kind, text if kind in (None, "text") else None, *empty) for kind, text in turn])
            for k, turn in enumerate(parts)]
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    segments = chat.format_turns(frame).orderBy("turn").collect()
    for turn, segment in zip(parts, segments, strict=True):
        body = segment["segment"]
        assert body.count("<|im_end|>") == body.count("<|im_start|>") == 1
        texts = "".join(chat.unescape(body[s["begin"]:s["stop"]]) for s in segment["loss"])
        assert texts == "".join(t for kind, t in turn if kind in (None, "text"))
    assert chat.parse(segments[1]["segment"]) == ("assistant", "a<\\|x")
    [other] = segments[4]["attachments"]
    assert (other["kind"], other["tokens"]) == ("other", 0)


def test_mix_keeps_clashing_columns_and_caps_empty_texts(spark):
    names = ["mix_key", "mix_range", "mix_order", "mix_start", "range_start", "mix_row"]
    rows = [(k, "" if k % 3 == 0 else "w " * (k % 5 + 1), "a" if k % 7 else "b", *[f"own{k}"] * len(names))
            for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    counted = mixing.mix_counts(frame).collect()
    assert len(counted) == 60 and all(r[n] == f"own{r['doc_id']}" for r in counted for n in names)
    assert max(r["repeats"] for r in counted) <= 3
    assert mixing.mixed(frame).columns == frame.columns
    alone = frame.filter("source = 'b'")  # one source is at its cap of its own words
    assert {r["repeats"] for r in mixing.mix_counts(alone).collect()} == {1}


def test_rare_language_fills_its_sample(spark):
    base = "abcdefgh klmnop"
    long = {"xx": "zuqi woxe vyku ", "yy": "bala meno sito "}
    rows = [(k, (long["xx"] * 200), "xx") for k in range(400)] + [(1000 + k, long["yy"] * 200 + base, "yy") for k in range(4)]
    rows += [(2000 + k, "kurz", "zz") for k in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.training_rows(frame, 16, 4000)
    total = collections.Counter()
    for lang, excerpt in found:
        total[lang] += len(excerpt)
    learned = sum(1 for d, _, lang in rows if lang == "yy" and zlib.crc32(str(d).encode()) % 4 != 2)
    assert 3500 <= total["xx"] <= 4000 + 16 and learned and 3500 <= total["yy"] <= 4000 + 16 and total["zz"] > 0
    model = language.Model(found)
    assert model.predict(["kurz kurz", "meno sito bala", "vyku zuqi woxe"])[0] == ["zz", "yy", "xx"]


MASK = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_features(text):
    """{feature: value} by plain loops: the hashed n-grams of words and of their shapes."""
    import xxhash

    words = text.split()
    single = [xxhash.xxh3_64_intdigest(w.lower()) & (quality.BIAS - 1) for w in words]
    shapes = []
    for k, word in enumerate(words):
        h = xxhash.xxh32_intdigest(quality.shape(word))
        again = k and single[k] == single[k - 1] and quality.shape(word) == quality.shape(words[k - 1])
        shapes.append(plain_mix(h ^ (0x5BD1E995 << 32) & MASK if again else h))
    groups = [single]
    for base, sizes in ((shapes, (1, 2, 3)), ([plain_mix(s) for s in single], (2, 3))):
        for n in sizes:
            grams = []
            for k in range(len(words) - n + 1):
                h = base[k]
                for j in range(1, n):
                    # Each longer gram is the one before of the same start, and the next word.
                    h = plain_mix(h * 31 + base[k + j] & MASK)
                grams.append(h & (quality.BIAS - 1))
            groups.append(grams)
    found = []
    for grams in groups:
        found += [(g, (n / len(words)) ** 0.5) for g, n in collections.Counter(grams).items()]
    return sorted(found)


def test_quality_by_plain_loops(documents):
    texts = [(r["text"] or "").encode() for r in documents.limit(30).collect()] + [b"", b"one", b"A a A a a a b"]
    owner, feature, value = quality.features(texts, quality.Words())
    rows = []
    for k, text in enumerate(texts):
        got = sorted(zip(feature[owner == k].tolist(), value[owner == k].tolist(), strict=True))
        want = plain_features(text)
        assert [g for g, _ in got] == [g for g, _ in want]
        assert np.allclose([v for _, v in got], [v for _, v in want])
        at = np.append(feature[owner == k], quality.BIAS).astype(np.int64)
        rows.append((at, np.append(value[owner == k], 1.0), k % 2))
    merged = []
    for at, x, label in rows:  # a feature that two n-grams share counts once in an update, by its last value
        last = dict(zip(at.tolist(), x.tolist(), strict=True))
        merged.append((np.array(list(last)), np.array(list(last.values())), label))
    got = quality.train(merged, epochs=2)
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.01)

    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(len(merged)):
            at, x, label = merged[k]
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * w[i]
                n[i] += g * g
    assert all(math.isclose(got[i], weight(i), rel_tol=1e-6, abs_tol=1e-9) for i in z)
    assert np.count_nonzero(got) == sum(1 for i in z if weight(i))
