"""Each operator against a brute-force version, an exact round trip or held-out truth, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from caselake.llm import language, lines, media, neighbours, packing, pieces, setjoin, suffixes, tokens, toxicity, words

LONG = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of old herbs and honey tonight"
DOCS = "doc_id long, text string, _cell string, key int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


CASES = [(1, LONG), (2, LONG), (3, "other " + LONG + " end"), (4, None), (5, ""), (6, "a\nb\n" + LONG + "\n" + LONG), (None, LONG), (8, "é" * 200), (9, "é" * 300), (7, LONG), (7, LONG)]


def removed(rows, width=50):
    known, out = {}, {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            known[b[p : p + width]] = min(i, known.get(b[p : p + width], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if i is not None and known[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        out[i] = hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def test_suffix_order_is_the_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(60):
        t = rng.integers(1, 4, int(rng.integers(1, 50)))
        assert suffixes.suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_dedup_against_brute_force(spark):
    got = suffixes.repeated_spans(docs(spark, CASES), cell_bytes=300, bucket_bytes=300).collect()
    want = removed(CASES)
    assert len(got) == len(CASES)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == want[r["_id"]] for r in got)
    assert suffixes.repeated_spans(docs(spark, [])).count() == 0


def test_line_dedup_against_brute_force(spark):
    got = lines.drop_similar_lines(docs(spark, CASES), cell_bytes=200)
    assert got.columns == ["doc_id", "text", "_cell", "key"]
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[1] == LONG and by[2] == "" and by[3] == "" and by[4] is None and by[5] == "" and by[6] == "a\nb" and by[None] == LONG
    assert lines.drop_similar_lines(docs(spark, [])).count() == 0


def test_jaccard_components(spark):
    near = LONG.replace("tonight", "today")
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(docs(spark, [*CASES, (20, near), (21, "one two"), (22, "ONE  two")])).collect()}
    n = len(LONG.split()) - 3
    assert got[1] == (n, 1) and got[2] == (n, 1) and got[20] == (n, 1) and got[4] == (0, 4) and got[5] == (0, 5) and got[22] == (1, 21) and got[None][1] is None
    assert setjoin.jaccard_components(docs(spark, [])).count() == 0


def linked_groups(rows, words, percent):
    sets, parent = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = t.split()
        k = min(words, len(w))
        sets[i] = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)} if w else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent", "limits"), [(4, 85, {}), (2, 50, {"list_rows": 4, "together": 500})])
def test_jaccard_groups_of_chained_copies_against_brute_force(spark, words, percent, limits):
    rng, rows = np.random.default_rng(4), []
    for i in range(160):
        b = int(rng.integers(6))
        w = [f"b{b}_{k}" for k in range(30 + b)]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(0, 50))}"
        w += [f"c{k}" for k in range(12)] if rng.random() < 0.3 else []
        rows.append((i * 3 + 1, " ".join(w[: int(rng.integers(1, 8))] if rng.random() < 0.1 else w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(frame, words=words, percent=percent, **limits).collect()}
    assert got == linked_groups(rows, words, percent)


@pytest.mark.parametrize("how", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(how, tile):
    rng = np.random.default_rng(5)
    made = [rng.integers(0, 3, (70, 64)).astype(np.uint8), rng.integers(0, 256, (33, 40, 3)).astype(np.uint8), np.zeros((300, 64), np.uint8)]
    back = list(media.tiff_pages(media.tiff_write(made, how, predictor=2, rows_per_strip=20, tile=tile)))
    assert len(back) == 3 and all((b == (m if m.ndim == 3 else m[:, :, None])).all() for m, b in zip(made, back, strict=True))


def test_lzw_across_table_resets():
    data = np.random.default_rng(6).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    assert media.lzw_decode(media.lzw_encode(data)) == data


def test_media_pages(spark):
    df = media.pages(media.to_tiff(docs(spark, CASES), "text"))
    assert {(r["doc_id"], bytes(r["pixels"]).rstrip(b"\0").decode()) for r in df.collect()} == {(i, t or "") for i, t in CASES}


def test_packing_is_gapless_and_whole(spark):
    texts = [*CASES, (30, " ".join(f"w{i}" for i in range(5000)))]
    rows = packing.pack(packing.pieces(docs(spark, texts), public_tokenizers.path("word_bpe_49k.json"), capacity=256), capacity=256, shard_rows=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [LONG, "don't a<|endoftext|>b it's \t x", "ΣΑΣ. é", "", "12ab !!? a_b İ", " 　a\x1cb  c\n\nd"]
    assert [x.tolist() for x in tokens.Encoder(path).encode(pa.array(texts))] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_context_report(spark):
    lengths = spark.createDataFrame([(n,) for n in (0, 3, 3, 5000, 7)], "n_tokens long")
    got = {r["n_tokens"]: r for r in tokens.context_report(tokens.length_histogram(lengths)).collect()}
    assert got[3]["tokens_kept"] == 12 and got[3]["docs_over"] == 2 and got[3]["tokens_cut"] == 5013 - 12 and got[5000]["tokens_cut"] == 0
    assert tokens.context_report(tokens.length_histogram(lengths.limit(0))).count() == 0


def test_n_best_against_all_segmentations():
    lattice = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))

    def every(u):
        edges, out = lattice.edges(u), []

        def go(at, g, ids):
            if at == 0:
                out.append((g, ids))
            for i, p, s in edges[at]:
                go(i, g + s, (*(lattice.spelt(u[i]) if p < 0 else (p,)), *ids))

        go(len(u), 0.0, ())
        return sorted(out, key=lambda x: (-x[0], [-len(lattice.raw[p].decode("utf-8", "replace")) for p in x[1]]))[:4]

    assert all(lattice.best(u) == every(u) for u in ("▁hello", "▁▁a", "▁Ouédn", "-" * 11, "▁▁▁▁▁", "aaaaaaa", "x"))
    assert [s for s, _ in lattice.best("ñü漢x")] == [s for s, _ in every("ñü漢x")]


def test_viterbi_of_many_units_equals_the_search_of_each():
    lattice, rng = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aeinrst-."), int(rng.integers(1, 40)))) for _ in range(300)] + ["漢\x00 a\x00b", "é" * 70]
    whole, lo, hi, _, _ = lattice.cut(texts)
    score, gap, ids, size = lattice.learn(whole, lo, hi)
    ends = np.cumsum(size)
    for k in range(len(lo)):
        want = lattice.best(whole[lo[k] : hi[k]])
        assert score[k] == want[0][0] and tuple(ids[ends[k] - size[k] : ends[k]]) == want[0][1]
        assert gap[k] == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)


@pytest.mark.parametrize("unit", ["-" * 100_000, "".join(chr(97 + k) for k in np.random.default_rng(2).integers(0, 26, 100_000))])
def test_long_units_take_time_in_proportion(unit):
    lattice = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    begun = time.process_time()
    got = lattice.best(unit)
    assert time.process_time() - begun < 20 and len(got) == 4 and all("".join(lattice.piece[p] for p in ids) == unit for _, ids in got)


def test_pieces_round_trip(spark):
    got = pieces.encode(docs(spark, [*CASES, (40, "日本 \U0001f600\n\n  tab\t")]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(CASES) + 1 and all(r["round_trip"] for r in got)


SIGNS = ["call foo(), then", "wait ... what", 'say "yes", (or "no"); x | y', "a != b, [1.5, .5].map(f);", "----------------", "日本, 12.50 é!? ((()))", " | a |  b |"]


def whole_text_n_best(lattice, text, n=4):
    """N best of an uncut text, lists of whole id tuples at every position."""
    u = "▁" + text.replace(" ", "▁")
    edges, top = lattice.edges(u), [[(0.0, ())]]
    for j in range(1, len(u) + 1):
        some = [(g - s, (*ids, *(lattice.spelt(u[i]) if p < 0 else (p,)))) for i, p, s in edges[j] for g, ids in top[i]]
        top.append(sorted(some)[: 8 * n])
    return top[-1]


def test_whole_texts_with_signs_against_an_uncut_search(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice = pieces.Lattice(path)
    got = {r["doc_id"]: r for r in pieces.encode(docs(spark, list(enumerate(SIGNS))), path).collect()}
    for k, text in enumerate(SIGNS):
        want = whole_text_n_best(lattice, text)
        made = [tuple(x) for x in got[k]["segmentations"]]
        assert got[k]["scores"] == [-g for g, _ in want[:4]] and len(set(made)) == 4
        assert {(-s, m) for s, m in zip(got[k]["scores"], made, strict=True) if -s < want[4][0]} == {x for x in want[:4] if x[0] < want[4][0]}
        assert got[k]["ids"] == got[k]["segmentations"][0]


def test_every_segmentation_decodes_to_its_text(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*enumerate(SIGNS), (90, ""), (91, "=" * 300), (92, LONG)]
    rows = pieces.encode(docs(spark, [*texts, (93, None)]), path).selectExpr("doc_id", "explode(segmentations) AS ids")
    back = pieces.decode(rows, path).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {*texts, (93, "")}
    assert sum(r["doc_id"] == 91 for r in back) == 4


def test_forward_sums_all_segmentations():
    lattice = language.Lattices(["a", "b", "ab", "ba", "▁", "▁a"])
    p = np.array([[0.3], [0.2], [0.4], [0.1], [0.5], [0.05], [1e-7]])
    # after the mark alone a|b|a, ab|a, a|ba; with it ▁a|b|a, ▁a|ba
    want = 0.5 * (0.3 * 0.2 * 0.3 + 0.4 * 0.3 + 0.3 * 0.1) + 0.05 * (0.2 * 0.3 + 0.1)
    assert np.isclose(np.exp(language.log_likelihood(lattice, ["aba"], p)[0, 0]), want)


def test_likelihood_of_long_words_is_not_cut():
    import math

    known = language.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lattice, rng = language.Lattices(known), np.random.default_rng(3)
    p = rng.random((len(known) + 1, 2)) / len(known)
    words = ["internationalization" * 20, "ab", "漢字" * 50, "x" * 3000]
    got = language.log_likelihood(lattice, words, p)
    for k, w in enumerate(words):
        m = language.MARK + w
        alpha = [[0.0] + [-math.inf] * len(m) for _ in range(2)]
        for j in range(1, len(m) + 1):
            for c in range(2):
                some = [alpha[c][i] + math.log(p[lattice.at[m[i:j]], c]) for i in range(max(0, j - lattice.longest), j) if m[i:j] in lattice.at]
                if m[j - 1] not in lattice.at:
                    some.append(alpha[c][j - 1] + math.log(p[-1, c]))
                top = max(some)
                alpha[c][j] = top + math.log(sum(math.exp(x - top) for x in some))
        assert np.allclose(got[k], [a[-1] for a in alpha], rtol=1e-9)


def test_language_of_texts_without_letters(spark):
    known = ["a", "b", "c", "d"]
    langs, p = language.fit(spark.createDataFrame([(1, "aab aba", "x"), (2, "ccd dcd", "y"), (3, None, None)], "doc_id long, text string, lang string"), known)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs(spark, [(1, "aba"), (2, "dcc"), (3, None), (4, "12 !"), (5, "")]), known, langs, p).collect()}
    assert got == {1: "x", 2: "y", 3: "und", 4: "und", 5: "und"}


def test_toxicity_reaches_misspellings():
    texts = [f"{w} word{i} and more text" for i in range(40) for w in ("horrible", "pleasant")]
    parts, bias = toxicity.train(texts, np.array([1, 0] * 40), steps=60)

    def logit(word):
        at, n = toxicity.grams([word], len(parts))
        return parts[at].sum() / n[0]

    assert logit("horribble") > logit("pleasantt")


def test_neighbours_are_exact_on_a_small_table(spark):
    rng = np.random.default_rng(9)
    vecs = rng.standard_normal((60, 8)).round(3)
    vecs[41] = vecs[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40)}
    for q, found in by.items():
        s = vecs @ vecs[q]
        want = [i for i in np.lexsort((np.arange(60), -s)) if i != q][:5]
        assert found == want
    assert {r["query_id"] for r in got} == {0, 20, 40}


def test_line_dedup_of_copies_and_near_copies_in_many_cells(spark):
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 400, int(rng.integers(5, 25)))] for _ in range(12)]
    texts = []
    for i in range(90):
        made = []
        for _ in range(int(rng.integers(1, 6))):
            words = list(base[int(rng.integers(len(base)))])
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"w{int(rng.integers(0, 400))}"
            made.append(" ".join(words))
        texts.append((i, "\n".join(made)))
    seen, want = [], {}
    for i, t in texts:
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if len(s) < 5 or not any(100 * len(s & e) >= 80 * len(s | e) for e in seen):
                kept.append(line)
            if len(s) >= 5:
                seen.append(s)
        want[i] = "\n".join(kept)
    for take in (1, 32):
        got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs(spark, texts), cell_bytes=1500, take=take).collect()}
        assert got == want


def test_word_hashes_follow_the_words():
    raw = ("The  quick\tbrown fox\n the dog É  x\n\n" + "z" * 3_000_000 + " the end").encode()
    at, h = lines.word_hashes(raw)
    found = raw.translate(words.LOWER).split()
    assert len(found) == len(at) == len(h) and len({*zip(found, h.tolist(), strict=True)}) == len(set(found)) == len(set(h.tolist()))
    assert len(lines.word_hashes(b"")[0]) == 0


def tokens_of(line):
    """Words; of Han and Thai characters each two neighbours, or the one of a run."""
    out = set()
    for word in line.lower().split():
        for part in re.findall("[\u4e00-\u9fff\u0e00-\u0e7f]+|[^\u4e00-\u9fff\u0e00-\u0e7f]+", word):
            out |= {part[k : k + 2] for k in range(max(1, len(part) - 1))} if part[0] >= "\u0e00" and part[0] <= "\u9fff" and part[0] not in "\u3001\u3002" else {part}
    return out


def test_short_and_spaceless_lines_against_brute_force(spark):
    han = "今天天气很好我们一起去公园散步吧然后回家吃饭看书"
    thai = "สวัสดีครับวันนี้อากาศดีมากเราไปเดินเล่นกัน"
    texts = [(1, f"All rights reserved.\nHome\n\n{han}"), (2, f"ALL RIGHTS reserved.\n\n  \nhome\nHome page\n{han}呀"), (3, f"{thai}\n好\nuse {han[:9]}Python é"), (4, f"{thai}ๆ\n好\n{han[::-1]}\nUse {han[:9]}python é\na b c d"), (5, "a b c d e\na b c\n" + han[12:] + "\n\U0001f600 “x”\n好"), (6, "\U0001f600 “X”\nd c b a\n,\n,")]
    seen, want = [], {}
    for i, t in texts:
        kept = []
        for line in t.split("\n"):
            s = tokens_of(line)
            if not s or not any(100 * len(s & e) >= 80 * len(s | e) for e in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[i] = "\n".join(kept)
    for size in (60, 3_000_000):
        got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs(spark, texts), cell_bytes=size).collect()}
        assert got == want
    assert want[2] == "\n  \nHome page" and want[6] == ","


def test_neighbours_walk_until_nothing_is_open(spark, monkeypatch):
    chain = [(i, [j for j in (i - 1, i + 1) if 0 <= j < 8], [0.0, 0.0][: 1 + (0 < i < 7)]) for i in range(8)]
    monkeypatch.setattr(neighbours, "build_graph", lambda *_: spark.createDataFrame(chain, neighbours.GRAPH))
    rows = spark.createDataFrame([(i, [1.0 + i, 0.0]) for i in range(8)], "vec_id long, embedding array<double>")
    got = neighbours.search(rows, k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 7), (0, 6), (0, 5)]


def test_hub_members_meet_in_other_blocks_each_round():
    ids = np.arange(300)
    met = set()
    for turn in range(8):
        order = np.argsort(neighbours.dealt(ids, turn))
        met |= {frozenset((0, int(x))) for k in range(0, 300, 128) for x in order[k : k + 128] if 0 in order[k : k + 128]}
    assert len(met) > 250


def test_toxicity_keeps_its_rule_on_small_samples():
    texts, labels = [f"once{i} seen{i}" for i in range(10)], np.array([0, 1] * 5)
    assert not toxicity.train(texts, labels, steps=5)[0].any()
    assert toxicity.train(texts, labels, steps=5, min_docs=1)[0].any()
