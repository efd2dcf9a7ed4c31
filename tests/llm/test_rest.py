import hashlib
import io
import itertools
import math
import tarfile
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.llm import chat, common, langid, media, pieces, secrets, sharding
from gridledger.llm import queries as Q
from tests.llm.helpers import AWKWARD, docs
from tests.oracle import compare

# language ID


def test_langid(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op1_langid(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_langid_awkward(spark):
    d = docs(spark, AWKWARD + [(50, "12 34 !!"), (51, "solo texto", None)])
    model = langid.train(d)
    got = {r.text: r.lang_pred for r in langid.predict(d.selectExpr("text", "text AS t"), model).collect()}
    assert {t for t, p in got.items() if p == "und"} == {None, "", "   ", "12 34 !!"} and got["solo texto"] == "en"
    left = langid.keep_languages(d)
    assert left.columns == d.columns and left.count() == len(AWKWARD) - 3 + 1 and {r.lang for r in left.collect()} == {"en"}
    assert langid.keep_languages(d, ["fr"]).count() == langid.keep_languages(docs(spark, [])).count() == 0
    assert langid.train(docs(spark, [(1, "words", None)])).langs == []


def test_langid_slices_and_columns(spark):
    """Slices change no count, wherever they end; columns of any name and nested ones are passed on."""
    texts = ["", "  ", "one", "ΑΣ ΒΣ.Γ σσ ΣΣ\n" * 40, "Ünï çødé 日本語 ab-cd'ef  x\ty " * 50, "unbroken" * 300, " lead and trail \n"]
    for text in texts:
        whole = langid.grams(text)
        for size in (1, 7, 64, 1000):
            assert (langid.grams(text, size) == whole).all()
    d = docs(spark, [(1, "one two three"), (2, "four five six")]).selectExpr("*", "named_struct('a b', 1, '`', array('x')) AS `odd, na``me`", "map('k v', 2) AS m")
    left = langid.keep_languages(d)
    assert left.columns == d.columns and {r["odd, na`me"]["a b"] for r in left.collect()} == {1} and left.schema["m"].dataType == d.schema["m"].dataType


def test_langid_against_plain_counts(spark, sf_dir):
    """The whole query decoded anew: n-grams counted with a dictionary, from the same sample."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    known = spark.createDataFrame([r for r in rows if r.lang and r.text and any(map(str.isalpha, r.text)) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    rank = {r._id: r._rank for r in langid.sampled(known).collect()}
    assert len(rank) == known.count()  # all are below the bound here

    def buckets(text):
        words = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()).split()
        b, out = b" " + b" ".join(words) + b" ", Counter()
        for n in (1, 2, 3, 4):
            for i in range(len(b) - n + 1):
                key = (n << 8 * n) + int.from_bytes(b[i : i + n], "big")
                out[key * 0x9E3779B97F4A7C15 % (1 << 64) >> 50] += 1
        return out

    langs = sorted({r.lang for r in known.collect()})
    counts = {x: Counter() for x in langs}
    for r in rows:
        if rank.get(r.doc_id, 0) % 5:
            counts[r.lang] += buckets(r.text)
    total = {x: sum(counts[x].values()) + 0.5 * 16384 for x in langs}
    code = langid.codewords(len(langs)).astype(int)
    mean = lambda b, bit, sign: np.mean([(counts[x][b] + 0.5) / total[x] for k, x in enumerate(langs) if code[k][bit] == sign])
    pull = {}

    def margins(text):
        out = []
        grams = buckets(text)
        for bit in range(code.shape[1]):
            for b in grams:
                if (b, bit) not in pull:
                    pull[b, bit] = math.log(mean(b, bit, 1) / mean(b, bit, -1))
            out.append(max(-20.0, min(20.0, 0.25 * sum(n * pull[b, bit] for b, n in grams.items()))))
        return out

    weighs = [r for r in rows if rank.get(r.doc_id, 1) % 5 == 0]
    good = np.mean([[code[langs.index(r.lang)][bit] * m > 0 for bit, m in enumerate(margins(r.text))] for r in weighs], axis=0)
    trust = np.log(np.clip(good, 0.51, 0.999) / (1 - np.clip(good, 0.51, 0.999)))
    trust /= trust.mean()
    text = {r.doc_id: r.text for r in rows}
    for r in langid.op1_langid(spark, sf_dir).collect():
        t = text[r.doc_id]
        if t is None or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        m = margins(t)
        loss = [sum(w * math.log1p(math.exp(-c * x)) for w, c, x in zip(trust, code[k], m)) for k in range(len(langs))]
        near = [math.exp(min(loss) - x) for x in loss]
        assert r.lang_pred == langs[loss.index(min(loss))] and abs(r.score - 1 / sum(near)) < 1e-6


def test_sample_of_a_large_language(spark):
    known = spark.range(30_000).selectExpr("if(id % 10 = 0, 'b', 'a') AS lang", "id AS doc_id", "'x' AS text")
    got = langid.sampled(known, 50).collect()
    hashes = known.selectExpr("lang", "doc_id", "xxhash64(doc_id) AS h").collect()
    bound = lambda n: min(1.0, 100 / n) * (1 << 53)
    for lang, n in (("a", 27_000), ("b", 3_000)):
        low = sorted((r.h, r.doc_id) for r in hashes if r.lang == lang and (r.h % (1 << 64)) >> 11 <= bound(n))
        assert [r._id for r in sorted(got, key=lambda r: r._rank) if r._lang == lang] == [i for _, i in low[:50]]


def test_codewords():
    for n in (2, 3, 6, 7, 30):
        code = langid.codewords(n).astype(int)
        apart = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        assert code.shape[0] == n and apart >= max(1, code.shape[1] // 5) and (abs(code.sum(axis=0)) < n).all()


# secrets


def test_secrets_sql(spark, sf_dir):
    compare(secrets.op4_secrets(spark, sf_dir), Q.oracle_sql()["op4_secrets"], sf_dir)


def test_secret_links(spark):
    key = "aB3" + "x" * 37
    texts = ["é AKIAABCDEFGHIJKLMN and " + key, key + " alone", 'password = "hunter2x" at https://db.example.com', "password: hunter2x only", "user=bob token=abcdefghijkl", "a deadbeefdeadbeef b", "AKIA123 " + "y" * 500 + key, None, ""]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, list(enumerate(texts)) + [(0, texts[0])])).collect()}
    assert got[0].spans == "access:2:20,key_part:25:65" and got[0].n_access == 1
    assert got[1].spans == got[3].spans == got[7].spans == got[8].spans == got[6].spans == ""
    assert got[2].spans == "short_assign:0:20"  # the endpoint alone lacks an identifier
    assert got[4].spans == "user:0:8,assign:9:27" and got[5].n_hex == 1
    assert (got[0].links, got[2].links, got[4].links, got[5].links) == ("key_part:25>access:2", "short_assign:0>endpoint:25", "user:0>assign:9", "")
    assert got[0].base_sha256 == hashlib.sha256(b"access:2:20").hexdigest() and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_every_linked_pair(spark):
    """The interval join against all pairs of random parts, with a text and a doc_id that repeat."""
    rnd = np.random.default_rng(8)
    held = {(i, sha): {(int(k), int(s)) for k, s in zip(rnd.integers(0, 7, 40), rnd.integers(0, 3000, 40))} for i, sha in ((1, "a"), (1, "b"), (None, "a"))}
    parts = spark.createDataFrame([(i, sha, k, s, s + 5) for (i, sha), own in held.items() for k, s in own], "doc_id long, text_sha256 string, kind_no int, start int, `end` int")
    needs = {3: (1, 5, 6), 4: (1, 5, 6), 5: (0, 2, 3, 4), 6: (0, 1, 2, 3, 4, 5)}
    for scope in (1, 90, 400):
        want = {(*key, k, s, j, t) for key, own in held.items() for k, s in own if k in needs for j, t in own if j in needs[k] and abs(s - t) <= scope}
        got = secrets.linked_pairs(parts, scope).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    kept = {(r.doc_id, r.text_sha256, r.kind_no, r.start) for r in secrets.link(parts, 90).collect()}
    near = lambda key, s, kinds: any(j in kinds and abs(s - t) <= 90 for j, t in held[key])
    assert kept == {(*key, k, s) for key, own in held.items() for k, s in own if k < 3 or (near(key, s, needs[k]) and (k < 6 or (near(key, s, (0, 2, 3, 4)) and near(key, s, (1, 5)))))}


def test_secrets_awkward(spark):
    assert secrets.find_secrets(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# media


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_png(body):
    payload = media.payload_of(body)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(body)] == body and not payload[len(body) :].strip(b"\0")
    stored = media.to_png(payload)
    assert media.from_png(stored) == payload and media.header_of(stored[:33]) == (64, len(payload) // 64, 8)


def test_media(spark, tmp_path):
    rows = AWKWARD + [(80, "x" * 64), (81, "x" * 65)]
    root = common.new_path(spark, "media-test")
    index = media.store(docs(spark, rows).coalesce(2), root)
    got = media.read_media(media.read_headers(index, root), root).collect()
    assert len(got) == len(rows)
    texts = Counter((t or "") for _, t in rows)
    want = {t: media.payload_of(t.encode()) for t in texts}
    for r in got:
        payload = next(p for t, p in want.items() if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert (r.payload_bytes, r.tail_crc32, r.width, r.height) == (len(payload), zlib.crc32(payload[-64:]), 64, len(payload) // 64)
        assert r.media_sha256 == r.digest
    fs, base = common.open_fs(root)
    shards = {r.shard for r in got}
    for s in shards:
        with fs.open_input_file(f"{base}/{s}") as f:
            members = tarfile.open(fileobj=io.BytesIO(f.read())).getnames()
        assert len(members) == len(set(members)) and {f"{r.digest}.png" for r in got if r.shard == s} == set(members)
    assert media.store(docs(spark, []), root).count() == 0


def test_media_query(spark, sf_dir):
    """Every column of the whole query, computed plainly."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op5_media(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        body = (text[r.doc_id] or "").encode()
        payload = body + b"\0" * (64 if not body else -len(body) % 64)
        rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]
        raw = b"".join(b"\0" + x for x in rows)
        piece = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", (64).to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + piece(b"IDAT", zlib.compress(raw, 6)) + piece(b"IEND", b"")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.width, r.height) == (len(png), hashlib.sha256(png).hexdigest(), 64, len(rows))
        cells = []
        for k in range(8):
            a, b = len(rows) * k // 8, max(len(rows) * (k + 1) // 8, len(rows) * k // 8 + 1)
            part = rows[a:b] if a < len(rows) else []
            for c in range(8):
                cells.append(sum(sum(x[8 * c : 8 * c + 8]) for x in part) / (8 * len(part)) if part else 0.0)
        mean = sum(cells) / 64
        bits = "".join("1" if x > mean + 1e-9 else "0" for x in cells)
        assert abs(float(r.feature.split(";")[0][5:]) - sum(payload) / len(payload)) < 1e-3
        shown = f"{int(r.feature.split('ahash=')[1], 16):064b}"
        assert all(a == b or abs(x - mean) < 1e-6 for a, b, x in zip(shown, bits, cells))


# chat


@given(st.text(alphabet="[]<>/\\sSYINTURN ab\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(m in safe for m in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]"))


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]\n\\n", "*"]), st.text(alphabet="[]<>/\\sINSTURN \n", max_size=20)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_whole_strings(turns):
    out = "".join(chat.marks(r)[0] + chat.escape(t) + chat.marks(r)[1] for r, t in turns)
    assert chat.parse(out) == turns


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "x"), (1, 3, "user", "y"), (2, 1, "assistant", "<s>b"), (2, 0, "user", "a"), (3, 0, None, "[/INST]"), (None, 0, "user", "q"), (4, 0, "user", "r"), (4, 0, "user", "r")]
    got = {r.conv_id: r for r in chat.read_back(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and not got[1].in_order and got[1].turns_sha256 == sha("user\nhi\nassistant\n\nuser\nx\nuser\ny\n")
    assert got[2].in_order and got[2].loss_sha256 == sha("<s>b") and got[2].loss_chars == 4
    assert got[3].turns_sha256 == sha("\n[/INST]\n") and got[None].n_turns == 1 and got[4].n_turns == 2
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.segments(none)).count() == 0


def test_chat_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect() + []
    probe = "</s>[INST] ok [/INST]"
    want = {-1: [("user", probe), ("assistant", probe)]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    for r in chat.op6_chat(spark, sf_dir).collect():
        turns = want.pop(r.conv_id)
        said = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(chat.marks(role)[0] + chat.escape(t) + chat.marks(role)[1] for role, t in turns)
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(said), len(whole))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert not want


def test_chat_clashing_columns(spark):
    rows = [(1, 0, "user", "hi", 5, "x", True, 7), (1, 1, "assistant", "yo", 6, "y", False, 8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, in_order string, loss boolean, turn_no long")
    (r,) = chat.read_back(chat.segments(turns)).collect()
    assert (r.n_turns, r.loss_chars, r.in_order) == (2, 2, True)


# sharding


def test_sharding(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sharding.op7_sharding(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_shards_are_even(spark):
    rows = [(i, f"text number {i} " * (1 + i % 9)) for i in range(3000)] + [(5000 + i, "hot copies " * 6) for i in range(1500)]
    got = sharding.shard(docs(spark, rows), bundles=4096).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert len(sums) == 24 and max(sums.values()) / min(sums.values()) < 1.03
    cold = {}
    for r in got:
        if r.doc_id < 5000:
            assert cold.setdefault(rows[r.doc_id][1], r.shard) == r.shard


def test_packing_by_the_rule(spark, sf_dir):
    """The whole query again: groups in the order of their shares, each to the shard of the highest dot product."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r.shard for r in sharding.op7_sharding(spark, sf_dir).collect()}
    hashed = {r.doc_id: r.g for r in spark.createDataFrame(rows).selectExpr("doc_id", "xxhash64(text IS NULL, text) AS g").collect()}
    groups = {}
    for r in rows:
        v = groups.setdefault(r.text, [0, 0, 0, hashed[r.doc_id]])
        v[0], v[1], v[2] = v[0] + len((r.text or "").encode()) + 8, v[1] + len((r.text or "").split()), v[2] + 1
    total = [sum(v[k] for v in groups.values()) for k in range(3)]
    limit = [total[k] / 24 / 1024 for k in range(3)]
    assert all(v[0] > limit[0] or v[2] > max(1, limit[2]) for v in groups.values()) and all(v[0] <= 0.75 * total[0] / 24 or v[2] == 1 for v in groups.values())
    left, place = [[1.0] * 3 for _ in range(24)], {}
    pull = sharding.PULL
    for text, v in sorted(groups.items(), key=lambda x: (-sum(x[1][k] / total[k] * 24 * pull[k] for k in range(3)), x[1][3])):
        share = [v[k] / total[k] * 24 for k in range(3)]
        score = [sum(s[k] * share[k] * pull[k] for k in range(3)) for s in left]
        place[text] = max(range(24), key=lambda s: score[s])
        left[place[text]] = [a - b for a, b in zip(left[place[text]], share)]
    same = sum(place[r.text] == got[r.doc_id] for r in rows)
    sums = Counter()
    for r in rows:
        sums[place[r.text]] += len((r.text or "").encode()) + 8
    mine = Counter()
    for r in rows:
        mine[got[r.doc_id]] += len((r.text or "").encode()) + 8
    assert same == len(rows) or sorted(sums.values()) == sorted(mine.values())


def test_more_groups_than_bundles(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(9000 + i, f"pair {i // 2}") for i in range(400)]
    got = sharding.shard(docs(spark, rows), bundles=64).collect()
    sums, of = Counter(), {}
    for r in got:
        sums[r.shard] += r.size
        if r.doc_id >= 9000:
            assert of.setdefault((r.doc_id - 9000) // 2, r.shard) == r.shard
    assert len(sums) == 24 and sum(sums.values()) == sum(len(t) + 8 for _, t in rows)


def test_sharding_awkward(spark):
    assert sharding.shard(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert sharding.shard(docs(spark, [])).count() == 0


# pieces


def test_draws_follow_the_lattice():
    """Sampled segmentations of a word come as often as their weights say."""
    model = pieces.pieces_of_model()
    word = " there"
    every = {}

    def walk(at, ids, log):
        if at == len(word):
            every[tuple(ids)] = log
        for n in range(1, len(word) - at + 1):
            k = names.get(word[at : at + n])
            if k is not None:
                walk(at + n, [*ids, k], log + model.weights[k])

    names = {raw.decode(): k for k, raw in enumerate(model.raw) if k > 258 and raw}
    walk(0, [], 0.0)
    total = sum(math.exp(x) for x in every.values())
    n = 20_000
    seen = Counter(tuple(x.tolist()) for x in pieces.encode_batch(model, list(range(n)), [word] * n))
    assert set(seen) <= set(every)
    for ids, log in every.items():
        p = math.exp(log) / total
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p / n) + 1e-3


@given(st.text(max_size=80))
@settings(max_examples=100, deadline=None)
def test_lossless(text):
    model = pieces.pieces_of_model()
    (ids,) = pieces.encode_batch(model, [3], [text])
    assert model.decode(ids.tolist()).decode() == text


def test_lists_decode_as_single_ids_do():
    model = pieces.pieces_of_model()
    texts = ["", "two words", "日本 😀\n", "  ", "x" * 300]
    lists = pieces.lists_of(pieces.encode_batch(model, list(range(5)), texts))
    assert pieces.texts_of(model, lists) == [model.decode(x) for x in lists.to_pylist()] == [t.encode() for t in texts]
    assert pieces.texts_of(model, lists.slice(1, 3)) == [t.encode() for t in texts[1:4]] and pieces.texts_of(model, lists.slice(0, 1)) == [b""] and pieces.texts_of(model, lists.slice(0, 0)) == []


def test_batches_do_not_matter():
    model = pieces.pieces_of_model()
    texts = [f"word{i} and more\nlines ▁ 日本 {i}" for i in range(50)]
    whole = pieces.encode_batch(model, list(range(50)), texts)
    alone = [pieces.encode_batch(model, [i], [texts[i]])[0] for i in range(50)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, alone))
    assert any(not np.array_equal(pieces.encode_batch(model, [i], ["something longer to cut"])[0], pieces.encode_batch(model, [0], ["something longer to cut"])[0]) for i in range(9))


def test_lattices_of_a_batch_are_not_held_together(monkeypatch):
    """Many different words take little more memory than their text; in how many parts they are filtered doesn't matter."""
    model = pieces.pieces_of_model()
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (80_000, 8))]
    texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
    tracemalloc.start()
    parts = pieces.encode_batch(model, list(range(len(texts))), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all lattices at once: 202 MB
    few = [*texts[:3], "", "a b a\n日本 " + "x" * 90, words[0] * 2]
    for size in (1, 60, 1 << 30):
        monkeypatch.setattr(pieces, "WORD_CHARS", size)
        again = pieces.encode_batch(model, list(range(len(few))), few)
        assert all(np.array_equal(a, b) for a, b in zip(again[:3], parts))
        assert all(np.array_equal(pieces.encode_batch(model, [k], [few[k]])[0], again[k]) for k in range(len(few)))


def test_pieces_query(spark, sf_dir):
    """The whole query: ids are drawn again one text at a time by plain filtering and sampling, and decode to the text."""
    model = pieces.pieces_of_model()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    text = {r.doc_id: r.text or "" for r in rows}
    names = {raw.decode(): k for k, raw in enumerate(model.raw) if raw and k not in set(model.byte_ids.tolist())}
    longest = max(map(len, names))

    def filtered(word):
        sums, arcs = [0.0], [[]]
        for end in range(1, len(word) + 1):
            own = [(n, names[word[end - n : end]]) for n in range(min(end, longest), 0, -1) if word[end - n : end] in names]
            if not own or own[-1][0] != 1:
                own.append((1, -1))
            logs = [sums[end - n] + (pieces.FALLBACK_LOG if k < 0 else model.weights[k]) for n, k in own]
            most = max(logs)
            share = [math.exp(x - most) for x in logs]
            sums.append(most + math.log(sum(share)))
            arcs.append([(n, k, p / sum(share)) for (n, k), p in zip(own, share)])
        return arcs

    seen = 0
    for r in pieces.op9_pieces(spark, sf_dir).collect():
        t = text[r.doc_id]
        assert model.decode(r.ids).decode() == t and r.lossless and (r.n_chars, r.n_pieces) == (len(t), len(r.ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if len(t) > 2000 or seen > 40:
            continue
        seen += 1
        key, out, begin = pieces.row_key(r.doc_id), [], 0
        for word in pieces._WORDS.findall(t):
            arcs, end, ids = filtered(word), len(word), []
            while end:
                draw = pieces.uniform(np.array([key], np.uint64), np.array([begin + end]))[0]
                up, pick = 0.0, None
                for n, k, p in arcs[end]:
                    up += p
                    if draw < up - 1e-12 or (n, k, p) == arcs[end][-1]:
                        pick = (n, k)
                        break
                ids.append(list(model.byte_ids[list(word[end - 1].encode())]) if pick[1] < 0 else [pick[1]])
                end -= pick[0]
            out += [int(x) for part in ids[::-1] for x in part]
            begin += len(word)
        assert out == r.ids


def test_pieces_round_trip(spark):
    d = docs(spark, AWKWARD)
    out = pieces.encode(d, keep=("lang", "size"))
    assert all(r.lossless and r.lang == "en" and r.size == 1 for r in out.collect())
    assert Counter(r.text for r in pieces.decode(out).collect()) == Counter(t or "" for _, t in AWKWARD)
    assert pieces.encode(docs(spark, [])).count() == 0


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    d, names = common.docs_of(spark, sf_dir), []
    for name, stage in P.STAGES[:-1]:
        before, d = d, common.settle(stage(spark, d, sf_dir), "test-stage")
        assert d.columns == before.columns
        names.append((name, d.count()))
    texts = Counter(r.text for r in d.collect())
    assert max(texts.values()) <= 3 and [n for n, _ in names][0] == "language ID"
    out = P.run(spark, sf_dir).collect()
    assert len(out) == names[-1][1] and all(r.lossless for r in out)
