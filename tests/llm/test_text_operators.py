"""The text operators against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelmill.llm import decontaminate, hmm_lm, language_id, line_dedup, linking, packing, simhash, substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, chunk string, keys int"
SPACE = b" \t\n\r\x0b\x0c"


def _docs(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "c", 1) for i, t in texts], DOCS)


def _awkward(seed: int, vocabulary: int = 6, n: int = 25, longest: int = 40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, longest)))) for i in range(n)]
    extra = [None, "", "   ", "x", "é ü\tñ\n\nß", texts[3][1], texts[3][1], "a b a b"]
    return texts + [(n + i, t) for i, t in enumerate(extra)]


def _words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("chunk_bytes", [60, 10**6])
def test_substring_dedup(spark, chunk_bytes):
    rows = _awkward(1)
    window = 3
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = _words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    found = {r.doc_id: r for r in substring_dedup.substring_dedup(_docs(spark, rows), window=window, chunk_bytes=chunk_bytes).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        w = _words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        r = found[i]
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept_text == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert {k for s in r.spans for k in range(s.start, s.end)} == gone
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_substring_dedup_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "z a b c d")]
    found = substring_dedup.substring_dedup(_docs(spark, rows), window=3).collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.kept_text) for r in found)
    assert kept == [(False, 1, "a b c d"), (False, 1, "a b c d"), (False, 2, "z"), (True, 0, "a b c d")]


@pytest.mark.parametrize("chunk_bytes", [50, 10**6])
def test_suffix_dedup(spark, chunk_bytes):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(25)]
    rows += [(30, "ab" * 30), (31, None), (32, ""), (33, "éé" * 10), (34, "x" * 9), (35, "the quick brown fox"), (36, "a quick brown fix")]
    length = 10
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(_docs(spark, rows), length=length, gram=4, chunk_bytes=chunk_bytes).collect()}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        r = found[i]
        assert bytes(r.kept) == bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed) == (len(t), int(gone.sum()))
        assert sum(s.end - s.start for s in r.spans) == int(gone.sum())


def test_suffix_sort_orders_suffixes():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    chunk = suffix_dedup.Chunk(pa.array(["ab" * 100 + "".join(rng.choice(list("abc"), 800))]), 20, 10)
    starts = rng.permutation(len(chunk.raw) - 20)[:600]
    order, number = chunk.classes(starts)
    raw = chunk.raw.tobytes()
    strings = [raw[i : i + 20] for i in order]
    assert strings == sorted(strings)
    assert number[-1] + 1 == len(set(strings))


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(30):
        w = base[:]
        for _ in range(rng.choice([0, 1, 2, 40])):
            w[rng.randrange(400)] = f"u{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(40, None), (41, ""), (42, "one"), (43, "One"), (44, rows[0][1].upper())]
    rows += [rows[1]]
    found = {r.doc_id: r for r in simhash.near_duplicates(_docs(spark, rows)).collect()}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    root = {i: i for i in prints}
    for _ in range(len(root)):
        root = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
    for i, p in prints.items():
        assert (found[i].fingerprint, found[i].component_id) == (f"{p:016x}", root[i])
    assert prints[40] == 0 and prints[42] == prints[43]


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    values = []
    for b in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(5):
            v = b
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= np.uint64(1) << np.uint64(k)
            values.append(v)
    values = np.unique(values)
    linked, to = simhash.trie_links(np.zeros(len(values), int), values)
    labels = np.arange(len(values))
    labels[linked] = to
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = np.arange(len(values))
    for _ in range(len(values)):
        want = np.array([want[near[i]].min() for i in range(len(values))])
    assert (labels == want).all()


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma.", "Ünder", "x1", "don't"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a  b\tc\n\n d "), (103, "<|endoftext|> x"), (104, "w " * 3000), (5, rows[5][1])]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    found = packing.best_fit_packing(_docs(spark, rows), capacity=capacity).collect()
    want = defaultdict(int)
    for i, t in rows:
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    by_doc = defaultdict(list)
    for r in found:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, tuple(ids.tolist())))
    for i, ids in want:
        pieces = sorted(set(by_doc[i]))
        assert tuple(x for _, _, p in pieces for x in p) == ids
        assert all(len(p) == capacity for _, _, p in pieces[1:])
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= -(-sum(r.length for r in found) // capacity) * 1.1 + 2


def test_plan_uses_every_piece_and_fills_well():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, np.exp(rng.normal(6, 1.2, 20000)).astype(int) + 1)
    counts = Counter(lengths.tolist())
    plan = packing.plan(counts)
    used = Counter()
    for combo, n in plan:
        assert sum(combo) <= 2048
        for x in combo:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in plan) <= -(-int(lengths.sum()) // 2048) + 2


def _language_rows(seed: int):
    rng = random.Random(seed)
    speech = {"aa": ["tion", "the", "ing", "of"], "bb": ["schen", "ung", "ein", "der"]}
    rows = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(rng.choice(speech[lang]) for _ in range(2)) for _ in range(30)), lang))
    return rows


def test_languages_do_not_depend_on_the_block(spark):
    texts = [("the cat sat on the mat and the dog ran home", "en"), ("der hund lief nach hause und die katze schlief", "de")]
    docs = spark.createDataFrame([(k, (texts[k % 2][0] + " ") * (1 + k % 7), texts[k % 2][1]) for k in range(40)], "doc_id long, text string, lang string").coalesce(1)
    whole, parts = ({r.doc_id: r for r in language_id.identify(docs, docs, block=b).collect()} for b in (1 << 20, 100))
    assert len(whole) == 40 and {k: r.lang_pred for k, r in whole.items()} == {k: r.lang_pred for k, r in parts.items()}
    assert all(abs(whole[k].score - parts[k].score) < 1e-9 for k in whole)


def test_language_id_held_out(spark):
    rows = [*_language_rows(1), (100, None, "aa"), (101, "", None), (102, "123 !!", "aa"), (103, "thetion thetion ofing schenung einder ungung " * 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(docs, docs.where("doc_id % 4 <> 1")).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[:80])
    assert [(found[i].lang_pred, found[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert {x.lang for x in found[103].languages} == {"aa", "bb"}
    assert len(found) == len(rows)


def test_language_sets_against_all_subsets():
    from itertools import combinations

    rng = np.random.default_rng(4)
    k, logs, at = 4, [], [0]
    for i in range(60):
        own = rng.choice(k, 1 + i % 3, replace=False)
        n = int(rng.integers(1, 60))
        true = rng.choice(own, n)
        part = rng.normal(-6, 2, (n, k))
        part[np.arange(n), true] += rng.uniform(1, 8)
        logs.append(part - part.max(axis=1, keepdims=True))
        at.append(at[-1] + n)
    found = language_id.chosen_sets(np.concatenate(logs), np.array(at))
    several = 0
    for i, part in enumerate(logs):
        n, best = len(part), None
        for size in range(1, k + 1):
            for members in combinations(range(k), size):
                like, share = np.exp(part[:, members]), np.full(size, 1 / size)
                for _ in range(language_id.ROUNDS):
                    r = like * share
                    share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                value = np.log((like * share).sum(axis=1)).sum() - size * (language_id.PENALTY + 0.5 * np.log(n))
                if best is None or value > best[0]:
                    best = (value, members, share)
        want = np.zeros(k)
        want[list(best[1])] = best[2]
        several += len(best[1]) > 1
        assert np.allclose(found[i], want, atol=1e-9)
    assert several > 10


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(docs, docs).collect()] == ["und"]


def test_forward_recursion_is_exact_over_segments():
    rng = np.random.default_rng(0)
    k = 3
    model = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm_lm.CELLS), k))
    cells, at = rng.integers(0, hmm_lm.CELLS, 60), np.array([0, 9, 10, 60])
    got = hmm_lm.log_likelihood(cells, at, model, length=7)
    for i in range(3):
        state, total = model.start, 0.0
        for c in cells[at[i] : at[i + 1]]:
            a = state * model.emit[:, c]
            total += np.log(a.sum())
            state = (a / a.sum()) @ model.move
        assert abs(total - got[i]) < 1e-9


def test_expected_counts_are_exact_over_cuts(monkeypatch):
    rng = np.random.default_rng(1)
    k = 3
    model = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm_lm.CELLS), k))
    cells, at = rng.integers(0, hmm_lm.CELLS, 90), np.array([0, 9, 10, 60, 74, 90])
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, hmm_lm.CELLS))
    for a, b in zip(at[:-1], at[1:], strict=True):
        e = model.emit[:, cells[a:b]].T
        n = b - a
        alpha, beta = np.zeros((n, k)), np.ones((n, k))
        for t in range(n):
            alpha[t] = (alpha[t - 1] @ model.move if t else model.start) * e[t]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = model.move @ (e[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
            x = alpha[t][:, None] * model.move * (e[t + 1] * beta[t + 1])[None]
            move += x / x.sum()
        gamma = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
        start += gamma[0]
        np.add.at(emit.T, cells[a:b], gamma)
    for length in (7, 256):
        monkeypatch.setattr(hmm_lm, "TRAIN_LENGTH", length)
        for got, want in zip(hmm_lm._expected(cells, at, model), (start, move, emit), strict=True):
            assert np.allclose(got, want, atol=1e-9)


def test_every_round_takes_all_training_documents():
    assert set(hmm_lm.ROUNDS) == {1}


def test_each_round_sees_all_texts_and_raises_the_likelihood(spark, monkeypatch):
    docs = _docs(spark, [(i, t) for i, t, _ in _language_rows(2)])
    seen, ran = [], hmm_lm._round
    monkeypatch.setattr(hmm_lm, "_round", lambda blocks, model, corpus: (seen.append(blocks.agg({"texts": "sum"}).first()[0]), ran(blocks, model, corpus))[1])
    training = docs.select("doc_id", "text")
    corpus = hmm_lm.corpus_counts(training, 2)
    _, cells, at = hmm_lm.tokens_of(training.select("text").toArrow()["text"], hashes=False)
    reached = []
    for rounds in (1, 2, len(hmm_lm.ROUNDS)):
        seen.clear()
        model = hmm_lm.train(training, corpus, states=3, rounds=(1,) * rounds)
        assert seen == [docs.count()] * rounds
        reached.append(hmm_lm.log_likelihood(cells, at, model).sum())
    assert reached == sorted(reached) and reached[-1] > reached[0]


def test_lm_score(spark):
    import math

    from pyspark.sql import functions as F

    rows = [(i, t) for i, t, _ in _language_rows(2)] + [(200, None), (201, ""), (202, "Unseen words"), (3, "dup row")]
    docs = _docs(spark, rows)
    found = hmm_lm.score_documents(docs, train_on=F.col("doc_id") % 5 != 1, states=3, rounds=(2, 1), chunk_bytes=2000).collect()
    tokens = [(i, [*_words((t or "").lower()), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert {r.train_tokens for r in found} == {n}
    held = [r for r in found if r.doc_id < 100 and r.doc_id % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_decontamination_finds_reparameterised_questions(spark):
    items = [(1, "A train leaves the old station with Alice at noon and carries 12 heavy boxes for 30 km to the market"), (2, "short item"), (3, None)]
    filler = "some other clean words that talk about nothing in particular and go on for a while"
    rows = [
        (1, f"{filler} {items[0][1]} {filler}"),
        (2, f"{filler} {items[0][1].replace('12', '99').replace('Alice', 'Bertha').replace('30 km', '7 miles')} {filler}"),
        (3, filler), (4, None), (5, ""), (6, "short item"),
        (7, items[0][1]), (7, items[0][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaked_items(_docs(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1), (7, 1)]
    assert all(0.5 <= r.coverage <= 1 for r in found)


def test_decontamination_wants_consistent_slots(spark):
    question = "we know that {a} boxes and {a} bags and {b} cups and {a} jars stand here"
    bench = spark.createDataFrame([(1, question.format(a=3, b=5))], "item_id long, text string")
    rows = [(1, question.format(a=8, b=2)), (2, "we know that 3 boxes and 4 bags and 5 cups and 6 jars stand here")]
    assert [r.doc_id for r in decontaminate.leaked_items(_docs(spark, rows), bench).collect()] == [1]


def test_decontamination_of_slots_with_marks_and_names_at_sentence_starts(spark):
    question = "{n} has {a} red apples{m} and {b} pears. Then {n} sells {a} of them at the market for {b} coins each"
    item = question.format(n="Tom", a=3, b=5, m="")
    rows = [(1, question.format(n="Bertha", a=8, b=2, m="")), (2, question.format(n="Tom", a=3, b=5, m=" --,")), (3, question.format(n="Ida", a="8,", b="(2)", m="!"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r.coverage for r in decontaminate.leaked_items(_docs(spark, rows), bench).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 1.0}


def test_decontamination_equals_its_sql(spark):
    import duckdb

    rng = random.Random(12)
    words = ["Tom", "Ann", "km", "miles", "3", "4,", "(7)", "red", "big", "the", "--", "Über", "x1", "5.", "why?"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 30)))) for i in range(20)] + [(30, None), (31, "")]
    swap = {"Tom": "Ida", "3": "8", "4,": "9", "km": "m"}
    rows = []
    for i in range(40):
        own = rng.choice(items[:20])[1].split()
        own = [swap.get(w, w) if i % 2 and rng.random() < 0.9 else w for w in own]
        rows.append((i, " ".join([rng.choice(words) for _ in range(i % 9)] + own + [rng.choice(words) for _ in range(5)])))
    rows += [(50, None), (51, " "), (52, "\t".join(items[3][1].split()))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.covered, round(r.coverage, 9)) for r in decontaminate.leaked_items(_docs(spark, rows), bench).collect())
    con = duckdb.connect()
    for name, table, key in (("documents", rows, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", table)
    assert found and found == sorted((d, i, c, round(v, 9)) for d, i, c, v in con.execute(decontaminate.OP8_SQL).fetchall())


def test_decontamination_at_every_alignment(spark):
    short = "seven quiet otters swim past the broken mill"
    long = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    edited = " ".join("other" if i % 10 == 9 else w for i, w in enumerate(long))
    rows = [(10 * k + n, f"{'pad ' * k}{t}{' tail' * 9}") for k in range(8) for n, t in ((1, short), (2, edited))]
    bench = spark.createDataFrame([(1, short), (2, " ".join(long))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.leaked_items(_docs(spark, rows), bench).collect()}
    assert found == {(10 * k + n, n): c for k in range(8) for n, c in ((1, 1.0), (2, 0.9))}


def test_decontaminate_typed_words_and_keys_beyond_the_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    item = "Anna walked 30km with two dogs and then X counted 12 birds near the old NASA tower before lunch"
    same = "Bert walked 45 miles with seven dogs and then Y counted twenty birds near the old ESA tower before lunch"
    clean = "a quiet text about rivers and stones that has nothing to do with any question of the list at all"
    rows = [(1, same), (2, clean), (3, item), (3, item), (4, None), (None, item), (5, "I " * 40), (6, clean + " " + same)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    clash = _docs(spark, rows).withColumns({c: F.lit(1) for c in ("key", "raw", "form", "slots")})
    found = [sorted((str(r.doc_id), r.item_id, r.covered, r.coverage) for r in decontaminate.leaked_items(clash, bench).collect())]
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    found.append(sorted((str(r.doc_id), r.item_id, r.covered, r.coverage) for r in decontaminate.leaked_items(clash, bench).collect()))
    assert found[0] == found[1] and {(d, i) for d, i, *_ in found[0]} == {("1", 1), ("3", 1), ("6", 1), ("None", 1)}
    assert all(c == 1.0 for *_, c in found[0])


def _shingles(line: str) -> frozenset:
    b = line.encode()
    return frozenset(b[i : i + line_dedup.SHINGLE] for i in range(max(1, len(b) - line_dedup.SHINGLE + 1)))


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 30))) for _ in range(60)]
    near = [x[:40] + "Z" + x[41:] for x in lines[:20]]
    pool = lines + near + lines[:10] + ["", "  ", "ab", "ab"]
    rng.shuffle(pool)
    rows = [(i, "\n".join(pool[i * 5 : i * 5 + 5])) for i in range(len(pool) // 5 + 1)] + [(90, None), (91, ""), (None, lines[0])]
    placed = [(i, n, x) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")) if x.strip()]
    placed.sort()
    texts = list(dict.fromkeys(x for *_, x in placed))
    sets = [_shingles(x) for x in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(texts))]
    own, seen, gone = {x: root[k] for k, x in enumerate(texts)}, set(), set()
    for i, n, x in placed:
        gone |= {(i, n)} if own[x] in seen else set()
        seen.add(own[x])
    found = {r.doc_id: r for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()}
    assert found[None].kept_text == lines[0] and found[90].kept_text is None and found[91].kept_text == ""
    for i, t in rows[:-3]:
        assert found[i].kept_text == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert found[i].n_removed == sum(d == i for d, _ in gone)
    assert found[0].doc.keys == 1


def test_line_dedup_of_rows_that_share_an_id(spark):
    rows = [(5, "a line that stands in two documents\nfirst own line of words"), (5, "another line that stands alone\na line that stands in two documents"), (6, "x y z")]
    found = sorted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(_docs(spark, rows + rows[:1])).collect())
    kept = {t for i, _, t in found if i == 5}
    lines = [x for t in kept for x in t.split("\n")]
    assert len(found) == 4 and sorted(set(lines)) == sorted({x for i, t in rows if i == 5 for x in t.split("\n")})
    assert lines.count("a line that stands in two documents") == 1


def test_line_dedup_recall_without_spaces(spark):
    rng = random.Random(8)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    han = "".join(chr(0x4E00 + i) for i in range(3000))
    small = "abcdefghijklmnopqrstuvwxyz"
    kinds = {
        "cjk": lambda: draw(han, 60), "url": lambda: f"https://{draw(small, 30)}/{draw(small, 60)}?q={draw(small, 20)}",
        "tabs": lambda: "\t".join(draw(small, 9) for _ in range(15)), "long words": lambda: " ".join(draw(small, 35) for _ in range(4)),
        "short words": lambda: " ".join(draw(small, 4) for _ in range(24)),
    }
    rows, pairs = [], []
    for kind, make in kinds.items():
        for _ in range(20):
            x = make()
            y = "Z" + x[1:]  # the first character differs
            assert len(_shingles(x) & _shingles(y)) >= 0.8 * len(_shingles(x) | _shingles(y))
            pairs.append((kind, len(rows) + 1))
            rows += [(len(rows), x), (len(rows) + 1, y)]
    removed = {r.doc_id for r in line_dedup.dedup_lines(_docs(spark, rows)).collect() if r.n_removed}
    caught = Counter(kind for kind, i in pairs if i in removed)
    assert removed <= {i for _, i in pairs} and all(caught[kind] >= 18 for kind in kinds), caught


@pytest.mark.parametrize("options", [{}, {"block": 16}])
def test_line_classes_of_one_bucket_with_many_classes(spark, monkeypatch, options):
    lines = [(k, f"class {k} line {n}") for k in range(20) for n in range(15)]
    ids = spark.createDataFrame([(x, k) for k, x in lines], "line string, k int").selectExpr("xxhash64(line) h", "k").collect()
    own = {r.h: r.k for r in ids}
    # all lines in one bucket, all sketches alike; only pairs of one class are similar
    monkeypatch.setattr(line_dedup, "_signatures", lambda t, *_: t.select("h").distinct().selectExpr("1L band", "h", "0L sketch"))

    def similar(pairs, *_):
        return spark.createDataFrame([(r.u, r.v) for r in pairs.collect() if own[r.u] == own[r.v]], "u long, v long")

    monkeypatch.setattr(linking, "similar", similar)
    docs = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(lines)], "doc_id long, text string")
    roots = {r.v: r.root for r in line_dedup.line_classes(docs, **options).collect()}
    found = {}
    for h, k in own.items():
        found.setdefault(k, set()).add(roots.get(h, h))
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == 20


def test_workers_get_a_text_once_and_keep_no_words(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    found = language_id.identify(docs, docs, keep_rows=True)
    plan = found._jdf.queryExecution().analyzed().toString()
    sent = next(x for x in plan.split("\n")[1:] if "Project" in x)
    assert sent.count("text#") == 1 and {r.doc.text for r in found.collect()} == {r.text for r in docs.collect()}
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    assert packing.pieces(docs.select("doc_id", "text"), path, remember=1000).count() == 40

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(packing._words(path, 1000).ids) if packing._words.cache_info().currsize else 0], pa.int64())})

    assert all(r.n == 0 for r in docs.select("doc_id").mapInArrow(kept, "n long").collect())


def test_line_pairs_of_a_crowded_bucket_are_ruled_out(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(807)]

    def changed(line, places):
        return [("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[rng.randrange(26)] if i in places else c) for i, c in enumerate(line)]

    # lines of which few are similar (0.75 mostly), and for ten of them one that is
    lines = [changed(base, set(rng.sample(range(0, 800, 9), 7))) for _ in range(80)]
    likes = [changed(x, {4 + 9 * n}) for n, x in enumerate(lines[:10])]
    texts = ["".join(x) for x in lines + likes]
    sets = [_shingles(t) for t in texts]
    like = {(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(like) >= 10
    compared, before = [], linking.similar

    def similar(pairs, *rest):
        compared.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_signatures", lambda t, *_: t.select("h").distinct().selectExpr("1L band", "h", "h sketch"))
    monkeypatch.setattr(linking, "similar", similar)
    roots = {r.v: r.root for r in line_dedup.line_classes(_docs(spark, list(enumerate(texts)))).collect()}
    hashes = [r.h for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").selectExpr("xxhash64(t) h").collect()]
    root = [roots.get(h, h) for h in hashes]
    own = list(range(90))
    for i, j in like:
        own = [own[j] if x == own[i] else x for x in own]
    assert len(set(zip(own, root, strict=True))) == len(set(own)) == len(set(root))
    assert sum(compared) < 90 * 89 / 2 / 4  # all pairs are 4005


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    labelled = spark.createDataFrame([], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([], "item_id long, text string")
    from pyspark.sql import functions as F

    for found in (
        substring_dedup.substring_dedup(empty), suffix_dedup.remove_repeats(empty), simhash.near_duplicates(empty), packing.best_fit_packing(empty),
        language_id.identify(labelled, labelled), hmm_lm.score_documents(empty, train_on=F.lit(True)), decontaminate.leaked_items(empty, bench), line_dedup.dedup_lines(empty),
    ):
        assert found.collect() == []


def test_digest_of_kept_words_is_plain_sha256(spark):
    from pyspark.sql import functions as F

    r = substring_dedup.substring_dedup(_docs(spark, [(1, " a\tb ")])).select(F.sha2("kept_text", 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"a b").hexdigest()

def _hard_rows():
    """Null ids, empty and null texts, repeated rows, ties, and a text far longer than the others."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
    return [(None, "no id at all here"), (None, None), (1, None), (2, ""), (3, "  "), (4, "same text in two rows"), (4, "same text in two rows"), (5, "same text in two rows"), (6, long), (7, long[:-1] + "x"), (None, long)]


def test_operators_take_hard_rows(spark):
    from pyspark.sql import functions as F

    rows = _hard_rows()
    docs = _docs(spark, rows)
    ids = sorted((i is None, i or 0) for i, _ in rows)
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.lit("aa"))).withColumn("score", F.lit("s")).withColumn("doc", F.lit(1))
    bench = spark.createDataFrame([(1, rows[6 + 2][1][:200]), (None, "words without an id that nobody ever uses here"), (2, None)], "item_id long, text string")
    for found in (
        substring_dedup.substring_dedup(docs), suffix_dedup.remove_repeats(docs), simhash.near_duplicates(docs), language_id.identify(labelled, labelled),
        hmm_lm.score_documents(docs, train_on=F.lit(True), states=2, rounds=(1,)), line_dedup.dedup_lines(docs),
    ):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found.collect()) == ids
    packed = packing.best_fit_packing(docs).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows} and sum(r.piece == 0 for r in packed) == len(rows)
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, bench).collect()}
    assert leaks == {(6, 1), (7, 1), (None, 1)}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert near[4] == near[5] == 4 and near[1] == near[2] == near[3] == 1


def test_near_copies_of_hard_rows(spark):
    from pyspark.sql import functions as F

    docs = _docs(spark, _hard_rows())
    classes = {r.text_hash: r.component_id for r in simhash.near_copies(docs).collect()}
    keyed = docs.select("doc_id", F.xxhash64(F.lower(F.coalesce("text", F.lit("")))).alias("h")).collect()
    found = {r.doc_id: classes.get(r.h) for r in keyed if r.doc_id is not None}
    assert found[4] == found[5] == 4 and found[6] == found[7] == 6 and found[1] == found[2] == 1
