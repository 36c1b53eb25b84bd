"""Tokens, pieces, language, extraction and decontamination against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quantloom.llm import decontam, fm_index, html_extract, language_id, sentencepiece, token_counts, token_output, word_cache
from quantloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_bpe():
    return tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.Unigram.from_file(tokenizer_path("piece_bpe_32k.model"))


def odd_texts(n, seed, alphabet="aab' \n\t,.éÉ́12ßz-_$'s'll|  \n x<>ΣÇ"):
    random.seed(seed)
    out = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 25))) for _ in range(n)]
    return out + [t + "<|endoftext|>" + x for t in out[:40] for x in ("", " ", "\n y", "z")]


def test_byte_bpe_equals_the_library(byte_bpe):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(byte_bpe), word_cache.ByteBpe(byte_bpe, max_words=50)
    for t in odd_texts(2000, 5):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_byte_bpe_with_white_space_after_a_newline(byte_bpe):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(byte_bpe), word_cache.ByteBpe(byte_bpe, max_words=50)
    texts = odd_texts(4000, 8, "xyé. \n\n\t\r\x1c\x85\u00a0\u00a0\u2003\u2028\u3000")
    for t in ["x\n\u00a0\u00a0y", "x\n\u00a0\ty", *texts]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_every_prefix_count_equals_the_library(word_bpe):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(word_bpe), token_counts.PrefixCounter(word_bpe)
    for t in [*odd_texts(300, 6), *odd_texts(150, 9, "你，。가각ᄀั١²№'re've'd!\"“”’İǆñ́̀\u00a0 ")]:
        want = [len(e.ids) for e in lib.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)]
        assert own.prefix(t).tolist() == want, t
        for budget in (0, 1, 3):
            assert token_counts.fit(np.diff(want), budget) == max(i for i, c in enumerate(want) if c <= budget), (t, budget)


def test_prefix_counts_inside_long_words(word_bpe):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(word_bpe), token_counts.PrefixCounter(word_bpe)
    random.seed(2)
    vocab = [t.removesuffix("</w>") for t in sorted(lib.get_vocab()) if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha()]
    for n in (1, 3, 60):
        t = "".join(random.choice(vocab) for _ in range(n))
        assert own.prefix(t).tolist() == [len(e.ids) for e in lib.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)], t
    long = "".join(random.choice("etaoinshrdlu") for _ in range(200_000))  # one word: a step a letter
    assert own.prefix(long)[-1] == len(lib.encode(long, add_special_tokens=False).ids)
    assert own.prefix(long)[150_000] == len(lib.encode(long[:150_000], add_special_tokens=False).ids)


def test_pairs_of_tokens_against_the_definition(word_bpe):
    own = token_counts.PrefixCounter(word_bpe).steps_of
    random.seed(3)
    tokens = random.sample(sorted(own.made), 3000)
    seen = {True: 0, False: 0}
    for a, t in zip(tokens, random.sample(tokens, len(tokens)), strict=True):
        if a.endswith("</w>") or not own.follows("", a):
            continue
        got = own.follows(a, t)
        assert got == (own.merged(a + t.removesuffix("</w>"), t.endswith("</w>")) == [a, t]), (a, t)
        seen[got] += 1
    assert min(seen.values()) > 20


def test_stored_counts_answer_any_budget(spark, sf, word_bpe, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "long words " * 200_000)], "doc_id long, text string"))
    token_counts.token_counts(docs, word_bpe, keep_steps=True).write.parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    assert {r.doc_id: (r.n_chars, len(r.steps)) for r in stored.collect()} == {r.doc_id: (len(r.text or ""),) * 2 for r in docs.collect()}
    lib, text = Tokenizer.from_file(word_bpe), {r.doc_id: r.text or "" for r in docs.collect()}
    for budget in (0, 7, 50):
        for r in token_counts.fit_within(stored, budget).collect():
            count = lambda n, t=text[r.doc_id]: len(lib.encode(t[:n], add_special_tokens=False).ids)
            assert count(r.fit_chars) <= budget
            assert r.fit_chars == len(text[r.doc_id]) or count(r.fit_chars + 1) > budget
    # 1024 times "long words ", whose last space costs nothing
    assert {r.doc_id: (r.n_tokens, r.fit_chars) for r in stored.collect()}[-2] == (400_000, 1024 * 11)


def test_token_orc(spark, sf, byte_bpe, tmp_path, capsys):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in token_output.token_orc_query(spark, docs, byte_bpe).collect()}
    lib, at = Tokenizer.from_file(byte_bpe), 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    p = str(tmp_path / "orc")
    token_output.write_token_orc(docs, p, byte_bpe)
    one = token_output.read_tokens(spark, p, [17])
    assert [r.doc_id for r in one.collect()] == [17]
    one.explain("formatted")
    assert re.search(r"PushedFilters: \[.*doc_id", capsys.readouterr().out)


def test_files_are_ordered_by_number(spark, tmp_path):
    one = spark.createDataFrame([(1, 0, 3, [7, 8, 2])], token_output.SCHEMA).coalesce(1)
    names = ["part-99999-a.orc", "part-100000-a.orc", "part-00002-a.orc"]
    for k, name in enumerate(names):
        one.selectExpr(f"cast({k} as long) as doc_id", "file_start", "n_tokens", "ids").write.orc(str(tmp_path / f"w{k}"))
        (tmp_path / "all").mkdir(exist_ok=True)
        next((tmp_path / f"w{k}").glob("part-*.orc")).rename(tmp_path / "all" / name)
    got = {r.doc_id: r.start for r in token_output.token_digest(spark, str(tmp_path / "all")).collect()}
    assert got == {2: 0, 0: 3, 1: 6}


def test_shared_ids_are_written_in_text_order(spark, byte_bpe):
    rows = [(1, "zebra zebra"), (1, None), (1, "apple"), (0, "x")] * 2
    got = [(r.doc_id, r.n_tokens) for r in token_output.token_orc_query(spark, spark.createDataFrame(rows, "doc_id long, text string"), byte_bpe).orderBy("start").collect()]
    assert got[:2] == [(0, 2)] * 2 and got[2:4] == [(1, 1)] * 2 and got[4] == got[5] and got[6] == got[7]


def test_token_orc_odd_rows(spark, odd_docs, no_docs, byte_bpe):
    got = token_output.token_orc_query(spark, odd_docs, byte_bpe).orderBy("start").collect()
    assert len(got) == odd_docs.count() and got[0].doc_id is None and got[0].start == 0
    assert [b.start for b in got[1:]] == [a.start + a.n_tokens for a in got[:-1]]
    assert {r.doc_id: r.n_tokens for r in got}[3] == 1
    assert token_output.token_orc_query(spark, no_docs, byte_bpe).count() == 0


def test_token_counts_odd_rows(odd_docs, no_docs, word_bpe):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_bpe)
    text = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    got = token_counts.token_counts(odd_docs, word_bpe).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        t = text[r.doc_id]
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 2048)
    assert token_counts.token_counts(no_docs, word_bpe).count() == 0


def test_unigram_equals_the_library(pieces):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True))
    for i, p in enumerate(m.pieces):
        p.score = score.get(i, p.score)
    lib = SentencePieceProcessor(model_proto=m.SerializeToString())
    total = lambda ids: sum(score.get(i, 0) for i in ids)
    for t in [*odd_texts(800, 7, "aab the' \n\t,.éÉ12ßz一😀  x<0x0A>"), " a", "a ", "  ", " ", "a" * 300]:
        own, want = pieces.encode(t), lib.encode(t)
        assert own == want or abs(total(own) - total(want)) < 1e-3, t  # ties may fall either way
        assert pieces.decode(own) == t
        for u in pieces.units(t) if t else ():
            coded = (sentencepiece.MARK + u.replace(" ", sentencepiece.MARK)).encode()
            assert np.frombuffer(pieces.known[u], "<u4").tolist() == pieces.one(coded)


def test_viterbi_against_all_segmentations():
    """Small vocabularies with scores of any kind: no segmentation of a word, bytes included, scores higher."""
    rng = random.Random(21)
    for _ in range(12):
        texts = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(12)} | {"▁", "▁a", "▁▁"})
        texts = [x for x in texts if x not in rng.sample(["a", "b", "é"], 2)]  # some letters only as bytes
        scored = [(300 + i, x, -rng.choice([0.5, 1.0, 2.0, 3.5, 7.0])) for i, x in enumerate(texts)]
        own = sentencepiece.Unigram(scored, list(range(256)))
        score = {x: s for _, x, s in scored}

        def all_ways(word, score=score, unknown=own.unknown):
            if not word:
                yield 0.0, []
            for n in range(1, len(word) + 1):
                if word[:n] in score or n == 1:
                    here = score.get(word[:n], unknown)
                    yield from ((here + s, [word[:n], *rest]) for s, rest in all_ways(word[n:]))

        value = {i: s for i, _, s in scored}
        for _ in range(40):
            word = "".join(rng.choice("aabbéc") for _ in range(rng.randint(1, 8)))
            ids = own.encode(word)
            best = max(s for s, _ in all_ways("▁" + word))
            got, k = 0.0, 0
            while k < len(ids):
                if ids[k] >= 300:
                    got, k = got + value[ids[k]], k + 1
                else:
                    got, k = got + own.unknown, k + (2 if ids[k] >= 0xC0 and ids[k] < 0xE0 else 3 if ids[k] >= 0xE0 else 1)
            assert got == pytest.approx(best), (word, ids)
            assert own.decode(ids) == word


def test_pieces_of_a_very_long_text(pieces):
    t = " ".join(f"word{k % 977} é{'x' * (k % 40)}" for k in range(150_000))
    assert len(t) > 3_000_000 and pieces.decode(pieces.encode(t)) == t


def test_pieces_odd_rows(odd_docs, no_docs):
    path = tokenizer_path("piece_bpe_32k.model")
    got = sentencepiece.encode_column(odd_docs, path, decoded_col="decoded").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.text is None:
            assert r.token_ids is None and r.decoded is None
        else:
            assert r.decoded == r.text.replace("▁", " ")
    assert sentencepiece.encode_column(no_docs, path).count() == 0
    both = sentencepiece.decode_column(sentencepiece.encode_column(odd_docs.select("doc_id", "text"), path), path)
    assert [r.decoded for r in both.collect()] == [r.decoded for r in got]


def test_remembered_words_are_bounded_and_stay_if_they_occur_again():
    own = sentencepiece.Unigram([(300, "▁", -1.0), (301, "a", -2.0), (302, "7", -2.5)], list(range(256)), max_words=20)
    plain = sentencepiece.Unigram([(300, "▁", -1.0), (301, "a", -2.0), (302, "7", -2.5)], list(range(256)))
    own.many, segmented = (lambda words, many=own.many: segmented.extend(words) or many(words)), []
    for k in range(200):
        text = f"often {k} a{k} {k}a"
        assert own.encode(text) == plain.encode(text)
        assert len(own.known) <= 20 + 4 and len(own.before) <= 20
    assert segmented.count("▁often".encode()) == 1 and len(segmented) == 601


def test_suffix_array_against_a_plain_sort():
    rng = np.random.default_rng(3)
    for _ in range(60):
        parts = [rng.integers(1, 3, rng.integers(0, 40)) for _ in range(rng.integers(1, 6))]
        text = np.concatenate([np.append(p, 0) for p in [*parts, parts[0]]])
        # a separator stands for a symbol of its own, smaller the earlier it is
        plain = np.where(text == 0, np.cumsum(text == 0) - 1, text + 1000).tolist()
        assert fm_index.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: plain[i:])


def test_every_known_word_of_a_shard_is_indexed(monkeypatch):
    seen = []
    index = decontam.FmIndex
    monkeypatch.setattr(decontam, "FmIndex", lambda text, n: seen.append(text) or index(text, n))
    win = decontam.Windows([("1", b"a b c d"), ("2", b"x y")], 3)
    place, length, _ = win.occurrences(np.array([1, 2, 0, 0, 3, 0, 1, 2, 3, 4, 0, 0, 5, 6, 0]))
    assert seen[0].tolist() == [1, 2, 0, 3, 0, 1, 2, 3, 4, 0, 5, 6, 0]
    assert sorted(zip(place.tolist(), length.tolist(), strict=True)) == [(6, 3), (7, 3), (12, 2)]


def test_decontamination_of_a_very_long_text(spark):
    long = "the same words again and again " * 300_000 + "zebra stripes in the dusty yard never looked so very fine"
    d = spark.createDataFrame([(1, long), (2, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "zebra stripes in the dusty yard never looked so very fine")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination_digest(d, b).collect()}
    assert got == {1: (1_800_011, 11), 2: (2, 0)}


def test_fm_index_against_scans():
    rng = np.random.default_rng(8)
    text = np.concatenate([np.append(rng.integers(1, 5, rng.integers(1, 30)), 0) for _ in range(40)])
    fm = fm_index.FmIndex(text, 4, rate=4)
    for length in (1, 2, 3, 6):
        pats = rng.integers(1, 5, (30, length))
        lo, hi = fm.search(pats)
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def plain_contamination(docs, bench):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    win = {}
    for item, t in bench:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for n in {len(k) for k in win}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in win:
                    hit.update(range(i, i + n))
                    items |= win[k]
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 10])
def test_decontamination(spark, sf, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60 if block > 10 else 15).collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(4).collect()] + [(900, "short item"), (901, "one"), (902, None), (903, ". ,"), (904, "twice twice twice")]
    docs += [(5000, bench[0][1]), (5001, "x " + bench[1][1].upper() + " y"), (5002, "a short item, ONE short ITEM"), (5003, "twice twice twice twice"), (5004, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination_digest(d, b).collect()}
    assert got == plain_contamination(docs, bench)
    cut = {r.doc_id: r.found.cleaned for r in decontam.decontaminate(d, b, cleaned=True).collect()}
    assert cut[5001].replace(".", "").split() == ["x", "y"] and cut[5004] is None


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "cat sat on the mat and then it left")], "item_id long, text string")
    got = decontam.decontaminate(odd_docs, b).collect()
    assert len(got) == odd_docs.count() and sum(r.found.n_hit > 0 for r in got) == 3 and got[0].row == "r"
    assert decontam.decontaminate(no_docs, b).count() == 0
    assert decontam.decontaminate(odd_docs, b.limit(0)).where("found.n_hit > 0").count() == 0


def test_gradients_against_differences():
    net = language_id.BiGru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(9)
    x, y = rng.integers(97, 123, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        h = net.h
        f, b = net.states(x, "f"), net.states(x, "b")
        z = np.einsum("lh,thn->ltn", net.p["v"][:, :h], f) + np.einsum("lh,thn->ltn", net.p["v"][:, h:], b) + net.p["b"][:, :, None]
        z = z - z.max(0)
        logp = z - np.log(np.exp(z).sum(0))
        return -np.mean([logp[y[n], t, n] for n in range(4) for t in range(5)])

    g = net.gradients(x, y)
    for k in net.p:
        for at in [tuple(rng.integers(0, s) for s in net.p[k].shape) for _ in range(6)] + ([(0, int(x[2, 1]))] if k[0] == "w" else []):
            old, eps = net.p[k][at], 1e-2
            net.p[k][at] = old + eps
            up = loss()
            net.p[k][at] = old - eps
            down = loss()
            net.p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), (k, at)


def test_reading_equals_training_states():
    net, x = language_id.BiGru(["a", "b", "c"]), np.random.default_rng(1).integers(0, 256, (64, 9)).astype(np.uint8)
    f, b, h = net.states(x, "f"), net.states(x, "b"), net.h
    z = np.einsum("lh,thn->ltn", net.p["v"][:, :h], f) + np.einsum("lh,thn->ltn", net.p["v"][:, h:], b)
    p = np.exp(z) / np.exp(z).sum(0)
    np.testing.assert_allclose(net.probabilities(x), p, atol=1e-5)


def test_language_accuracy_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.language_digest(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) > 0.95


def test_language_sample_holds_whole_texts_once(spark):
    long = "żółw " * 40_000
    rows = [(None, long, "pl")] * 300 + [(k, f"text {k}", "en") for k in range(400)] + [(1000, None, "en"), (1001, "", "en"), (1002, "unlabelled", None)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=400)
    assert [t for lang, t in got if lang == "pl"] == [long.encode()]
    held = {f"text {k}" for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {t.decode() for lang, t in got if lang == "en"} == {f"text {k}" for k in range(400)} - held
    few = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert 20 < sum(lang == "en" for lang, _ in few) < 90


def test_language_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_digest(odd_docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 9)) and got[1][0] == "en"
    assert language_id.language_digest(no_docs).count() == 0
    assert {r.language.lang_pred for r in language_id.predict(odd_docs, None).collect()} == {"und"}


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>home</a></header><div id="cookie-notice">We use cookies to do a lot of things, please accept them all today.</div>
<div class="wrap"><BODY><h1>Title here</h1><p>Long   paragraph of text that goes&nbsp;on and on with a lot of words, really &amp; truly.</p><p>Ok.<br>Yes.</p>
<p>Another long paragraph of text here, with <a href=x>a link</a> in it, and more words to make it long.</p><ul><li>item one<li>item two</ul>
<div class="ad">Buy now this amazing thing that has a long long text to buy</div><script>if (a < b) "</p>"</script><p>Final paragraph with closing words and nothing else to say here.</p></BODYEND>
<div class="sidebar"><p>Side text that is long enough to be mistaken for content, maybe it is not.</p></div><div id="comments"><article class="comment"><p>A reader comment that is quite long and could be mistaken for text.</p></article></div>
<form><p>Subscribe to our newsletter with long text here that may be mistaken.</p><input></form></div><footer>&copy; foo</footer></body></html>"""
WANT = "Title here|Long paragraph of text that goes on and on with a lot of words, really & truly.|Ok. Yes.|Another long paragraph of text here, with a link in it, and more words to make it long.|item one|item two|Final paragraph with closing words and nothing else to say here.".replace("|", "\n\n")


@pytest.mark.parametrize(("a", "b"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_extraction(a, b):
    assert html_extract.extract(PAGE.replace("<BODY>", a).replace("</BODYEND>", b)) == WANT


def plain_page(rng):
    """A page of a known article: no semantic element, no class or id; menus, side text and notes around it."""
    say = lambda n: " ".join(rng.choice(["stone", "river", "of", "the", "light", "and", "moved", "under", "an", "old"]) for _ in range(n)).capitalize() + "."
    blocks = [say(rng.randint(3, 6))]
    html = [f"<h1>{blocks[0]}</h1>"]
    for _ in range(rng.randint(4, 9)):
        kind = rng.choice(["p", "p", "p", "short", "list", "quote"])
        if kind == "list":
            items = [say(rng.randint(1, 4)) for _ in range(rng.randint(2, 4))]
            html.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            blocks += items
        else:
            text = say(4 if kind == "short" else rng.randint(40, 90))
            html.append({"quote": f"<blockquote>{text}</blockquote>"}.get(kind, f"<p>{text}</p>"))
            blocks.append(text)
    blocks.append(say(60))
    html.append(f"<p>{blocks[-1]}</p>")
    links = lambda n: "".join(f"<li><a href=/{k}>{say(2)}</a></li>" for k in range(n))
    body = rng.choice(["<div><div>%s</div></div>", "<table><tr><td>%s</td></tr></table>", "<section><div>%s</div></section>", "<div>%s</div>"]) % "\n".join(html)
    before = "".join(rng.sample([f"<div><ul>{links(8)}</ul></div>", f"<div><a href=/>{say(2)}</a> <b>{say(2)}</b></div>", f"<nav>{links(5)}</nav>"], rng.randint(1, 3)))
    after = "".join(rng.sample([f"<div><ul>{links(6)}</ul></div>", f"<div><span>{say(2)}</span> <a href=#>{say(2)}</a></div>", f"<footer><p>{say(30)}</p></footer>", f"<form><p>{say(30)}</p><input></form>"], rng.randint(1, 4)))
    return f"<html><head><title>{say(3)}</title></head><body>{before}{body}{after}</body></html>", "\n\n".join(blocks)


def test_extraction_of_known_articles_without_semantic_elements(monkeypatch):
    rng = random.Random(12)
    pages = [plain_page(rng) for _ in range(150)]
    got = [html_extract.extract(h) for h, _ in pages]
    assert got == [w for _, w in pages]
    # the clusters choose: without them, or with all lines in one, other texts come back
    monkeypatch.setattr(html_extract, "clusters", lambda ratio, kind: (np.zeros(len(ratio), bool), 0.0))
    assert not any(html_extract.extract(h) for h, _ in pages)
    monkeypatch.setattr(html_extract, "clusters", lambda ratio, kind: (np.ones(len(ratio), bool), 0.0))
    assert sum(html_extract.extract(h) != w for h, w in pages) > len(pages) // 2


def test_the_same_text_without_article_and_main(spark, sf):
    html = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect() if r.html]
    for h in html:
        assert html_extract.extract(re.sub(r"<(/?)(article|main)\b", r"<\1div", h)) == html_extract.extract(h)


def test_extraction_of_a_very_long_page():
    text = [f"Paragraph {k} with a few words that make it long enough to be text." for k in range(30_000)]
    page = "<nav><a href=/>home</a></nav><div>" + "".join(f"<p>{x}</p>" for x in text) + "</div><footer>end of it all</footer>"
    assert html_extract.extract(page) == "\n\n".join(text)


def test_extraction_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text"), (None, "u", "</div></p>x<b>y</b>"), (5, "u", "<a href=x>only link</a>"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<p>&lt;tag&gt; &#233;&eacute;"), (8, "u", "<nav>menu only</nav>")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(d).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("just text", 9), None: ("xy", 2), 5: ("only link", 9), 6: ("deep", 4), 7: ("<tag> éé", 8), 8: ("", 0)}
    assert html_extract.main_text(d.limit(0)).count() == 0


def test_counts_of_every_code_point_below_3100(word_bpe):
    c = token_counts.PrefixCounter(word_bpe)
    texts = [t for cp in range(0x3100) for t in (chr(cp), f"a{chr(cp)}b", f"!{chr(cp)}!", f"..{chr(cp)}..")]
    texts += ["\x1b[0m text", "x" * 50 + "\x7f" * 30, "\x1c\x1d y", "it\x00's", "''\x01'll"]
    want = [len(e.ids) for e in c.tk.encode_batch(texts, add_special_tokens=False)]
    assert [int(c.prefix(t)[-1]) for t in texts] == want
    odd = [t for t in texts if any(ord(x) < 32 or ord(x) == 127 for x in t)] + random.Random(1).sample(texts, 500)
    for t in odd:
        assert c.prefix(t).tolist() == [len(e.ids) for e in c.tk.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)], t
    with pytest.raises(ValueError):
        c.steps_of.prefixes("a\x00b")
    assert c.steps_of.prefixes("hello")[-1] == 1


def test_marks_on_what_holds_the_article():
    said = [f"Paragraph {i} of the story, with a good deal of text in it to read and to think of." for i in range(4)]
    art = "<h1>Title of it</h1>" + "".join(f"<p>{x}</p>" for x in said)
    side = '<div class="sidebar"><ul><li><a href=x>One link</a></li><li><a href=y>Two links</a></li></ul></div>'
    readers = '<div class="comments">' + "".join(f"<p>Reader {i} says that this is a long comment about the story and more of it.</p>" for i in range(12)) + "</div>"
    want = "\n\n".join(["Title of it", *said])
    page = "<html><body><nav><a href=a>Home</a></nav>{}<footer>(c) us</footer></body></html>".format
    for tag in ("div", "section", "article"):
        for name in ("wrap has-sidebar", "page no-sidebar", "post-content comments-open", "layout-with-banner", "story share-enabled"):
            for inner in (art, art + side, art + readers):
                assert html_extract.extract(page(f'<{tag} class="{name}">{inner}</{tag}>')) == want, (tag, name)
    inside = [art, art + side, art + readers, f'<div class="wrap has-sidebar">{art}{side}</div>', f'<div class="page no-sidebar"><div class="post-content comments-open">{art}</div>{readers}</div>']
    for inner in inside:
        assert html_extract.extract(page(f'<form action="/x"><input name=v>{inner}</form>')) == want
    assert html_extract.extract(page(f"<div>{art}</div>{readers}")) == want
    assert html_extract.extract(page(f'<div>{art}</div><form class="signup"><p>Give us your address, we ask you for it, and a name.</p></form>')) == want
