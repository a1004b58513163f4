"""Chat formatting round trips and the language model's scores."""

import collections
import json
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.llm import chat, lm
from tests.llm.test_text_operators import table

HARD = ["</s>[INST] ok [/INST]", "&lt;|user|&gt; &amp;amp; &#91;", "<|assistant|>x</s>", "", None, "a|>b<|c", "é\n🎉\\", "|", "&", "&#124;"]


def test_turns_come_back_as_they_were(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)], "extra") for c in range(6) for t, role in enumerate(["system", "user", "assistant", "to|ol>\n", None, "assistant"])]
    rows += [(None, 0, "user", "x", "e"), (None, 1, "assistant", "y", "e"), (7, 0, "user", "same", "e"), (7, 0, "user", "same", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = chat.read_back(chat.format_chats(chat.canonical_turns(df))).collect()
    want = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t, role or "", text or ""))
    assert len(back) == len(want)
    for r in back:
        turns = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(t["role"], t["text"]) for t in r.turns] == turns
        assert list(r.learned) == [text for role, text in turns if role == "assistant"]
        assert not re.search(r"\[", r.formatted) and r.formatted.count("</s>") == len(turns)


def test_empty_conversations(spark):
    assert chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    none = spark.createDataFrame([(1, [])], f"conv_id long, turns {chat.TURNS}")
    (r,) = chat.read_back(chat.format_chats(none)).collect()
    assert r.formatted == "" and r.turns == [] and r.learned == []


def test_layouts_are_chosen_by_fingerprint(spark):
    pair = spark.createDataFrame([(1, "q", "a", "!"), (2, None, "only", "!"), (3, "q", None, "!")], "conv_id long, prompt string, response string, other string")
    got = {r.conv_id: [(t["role"], t["text"]) for t in r.turns] for r in chat.canonical_turns(pair).collect()}
    assert got == {1: [("user", "q"), ("assistant", "a")], 2: [("assistant", "only")], 3: [("user", "q")]}
    listed = spark.createDataFrame([(1, [("user", "hi"), (None, "yo")]), (2, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    got = {r.conv_id: [(t["role"], t["text"]) for t in r.turns] for r in chat.canonical_turns(listed).collect()}
    assert got == {1: [("user", "hi"), ("", "yo")], 2: []}
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))
    assert chat.fingerprint(pair.schema) == chat.fingerprint(pair.drop("other").schema) != chat.fingerprint(listed.schema)


def test_json_records_of_mixed_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3},
        {"conversations": [{"from": "human", "value": "a"}]},
        {"prompt": "p", "response": "r", "meta": {"prompt": 1}},
        {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": "n", "output": "o", "system": "s"},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, None), (7, "{broken")], "conv_id long, body string")
    got = {r.conv_id: (r.layout, [(t["role"], t["text"]) for t in r.turns]) for r in chat.canonical_turns_json(df, "body").collect()}
    assert got[0] == ("messages", [("user", "hi"), ("assistant", "yo")])
    assert got[1] == ("exchanges", [("human", "a")])
    assert got[2] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert got[3] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert got[4] == ("instruction", [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")])
    assert got[5] == got[6] == got[7] == (None, [])


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), "\0end"]


def prose(rng, n, language):
    return " ".join(f"{language}{rng.integers(0, 40)}" for _ in range(n))


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_base_scores_and_held_out_gain(spark, hot, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "START_STEPS", 150)
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, 150, ["le ", "der ", "the "][i % 3])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Unseen WORDS\there"), (None, "nobody"), (7, rows[7][1]), (8, "a second text")]
    got = lm.lm_scores(table(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))
        want[(str(i), held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base, 6))] += 1
    assert collections.Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    long = [r for r in got if r.held_out and r.n_tokens > 100]
    assert long and sum(r.score for r in long) > sum(r.base_score for r in long)


@pytest.mark.parametrize("most", [60, 0])
def test_scores_do_not_depend_on_the_pairs_that_travel(spark, most, monkeypatch):
    monkeypatch.setattr(lm, "start_training", lambda tables, sequences: lm.Attention.start())
    monkeypatch.setattr(lm, "train_everywhere", lambda tokens, tables, start: start)
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 60, ["le ", "der ", "the "][i % 3])) for i in range(60)] + [(500, None), (None, "nobody"), (7, "twice the "), (7, "twice the ")]

    def scores():
        got = lm.lm_scores(table(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
        return sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)

    want = scores()
    monkeypatch.setattr(lm, "PAIRS", most)
    got = scores()
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-4)


def test_lm_of_an_empty_table(spark):
    assert lm.lm_scores(table(spark, []), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_windows_score_each_id_once():
    sequences = [np.arange(n, dtype=np.uint16) + 1 for n in (0, 1, 15, 16, 17, 100)]
    x, y, live, owner = lm.windows(sequences, 999)
    for i, s in enumerate(sequences):
        own = y[owner == i][live[owner == i]]
        assert own.tolist() == [*s.tolist(), 999]
        before = x[owner == i][:, -lm.STRIDE :][live[owner == i]]
        assert before.tolist() == [999, *s.tolist()]


def test_every_target_of_a_training_document_is_trained_on(spark, tmp_path):
    folder = str(tmp_path)

    class Classes:
        def __getitem__(self, ids):
            if ids.shape[1] == lm.STRIDE:  # targets; -1 pads
                with open(f"{folder}/{os.getpid()}", "a") as out:
                    out.write(f"{(ids >= 0).sum()}\n")
            return np.where(ids < 0, lm.CLASSES, ids % lm.CLASSES)

    class Tables:
        end, class_of, input_of, prior = 999, Classes(), np.r_[np.arange(1000) % lm.INPUTS, lm.INPUTS], np.zeros((1000, lm.CLASSES), np.float32)

    class Shared:
        value = Tables()

    lengths = [3, 15, 16, 700, 5000]
    rows = [(i, bytearray(np.arange(n, dtype=np.uint16) % 900)) for i, n in enumerate(lengths)]
    lm.train_everywhere(spark.createDataFrame(rows, "doc_id long, ids binary"), Shared(), lm.Attention.start())
    seen = sum(int(line) for name in os.listdir(folder) for line in open(f"{folder}/{name}"))
    assert seen == sum(n + 1 for n in lengths)


def test_context_and_classes():
    assert lm.LENGTH - lm.STRIDE >= 16  # a target of a long text sees 17 subwords at least
    assert lm.CLASSES >= 64


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    m = lm.Attention.start(7, 5, lm.WIDTH)
    inputs = rng.integers(0, 7, (3, lm.LENGTH))
    inputs[0, :5] = 7  # padding leads
    target, live = rng.integers(0, 5, (3, lm.STRIDE)), rng.random((3, lm.STRIDE)) < 0.8
    prior = rng.normal(size=(3, lm.STRIDE, 5)).astype(np.float32)

    def probabilities(m):
        p, _ = lm.attend(m, inputs, prior)
        return p / p.sum(-1, keepdims=True)

    def loss(flat):
        picked = np.take_along_axis(probabilities(m.filled(flat)), target[:, :, None], 2)[:, :, 0]
        return float(-(np.log(picked) * live).sum() / live.sum())

    flat = m.flat()
    g = np.concatenate([x.ravel() for x in lm.gradients(m, inputs, target, live, prior)])
    for k in rng.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[k]) < 2e-3
    p = probabilities(m)
    assert np.allclose(lm.log10_classes(m, inputs, prior, target), np.log10(np.take_along_axis(p, target[:, :, None], 2)[:, :, 0]), atol=1e-3)


def small_tables(seed, vocabulary=50):
    rng = np.random.default_rng(seed)
    pairs = np.unique(rng.integers(0, vocabulary * vocabulary, 300))
    return lm.build_tables(pa.table({"pair": pairs, "n": rng.integers(1, 20, len(pairs))}), vocabulary - 1, vocabulary)


@pytest.mark.parametrize("size", [1, 300])
def test_scores_equal_a_loop_over_targets(size):
    rng = np.random.default_rng(6)
    tables, m = small_tables(3), lm.Attention.start()
    m = m.filled(size * rng.normal(0, 0.5, m.flat().size))  # exp of large ones overflows
    sequences = [rng.integers(0, 49, n).astype(np.uint16) for n in (0, 1, 16, 47)]

    def log10(s):
        ids, total = [tables.end, *s.tolist(), tables.end], 0.0
        for k in range(1, len(ids)):
            place = (k - 1) % lm.STRIDE  # of the target in its window
            first = max(0, k - place - 1 - (lm.LENGTH - lm.STRIDE))
            seen = ids[first:k]
            columns = np.arange(lm.LENGTH - lm.STRIDE + place - len(seen) + 1, lm.LENGTH - lm.STRIDE + place + 1)
            e = tables.input_of[seen]
            w = m.key[e].astype(float) @ m.query[e[-1]] / lm.WIDTH**0.5 + m.distance[place, columns]
            w = np.exp(w - w.max())
            logits = (w / w.sum()) @ m.value[e] @ m.out + m.bias + tables.prior[ids[k - 1]]
            logits -= logits.max()
            c = tables.class_of[ids[k]]
            total += (logits[c] - np.log(np.exp(logits).sum())) / np.log(10) + tables.emission(np.array([ids[k - 1]]), np.array([ids[k]]))[0]
        return total

    assert np.allclose(lm.log10_probabilities(m, tables, sequences), [log10(s) for s in sequences], rtol=1e-3)


def test_frequent_subwords_have_embeddings_of_their_own():
    total = np.arange(1000)
    inputs = lm.inputs_of(np.r_[np.arange(1000) % lm.CLASSES, lm.CLASSES], total)
    assert sorted(inputs[1000 - lm.OWN_INPUTS : 1000]) == list(range(lm.OWN_INPUTS))
    assert inputs[5] == lm.OWN_INPUTS + 5 and inputs[-1] == lm.INPUTS


def test_held_out_texts_score_better_than_the_word_counts(spark):
    rows = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).filter("held_out").collect()
    assert len(rows) > 100 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_ids_beyond_16_bits_are_refused(spark):
    with pytest.raises(ValueError):
        lm.lm_scores(table(spark, []), "unread", vocabulary=70_000)


def test_probabilities_within_classes_sum_to_one():
    rng = np.random.default_rng(2)
    vocabulary = 50
    import pyarrow as pa

    pairs = np.unique(rng.integers(0, vocabulary * vocabulary, 300))
    tables = lm.build_tables(pa.table({"pair": pairs, "n": rng.integers(1, 20, len(pairs))}), vocabulary - 1, vocabulary)
    for before in range(0, vocabulary, 7):
        p = 10 ** tables.emission(np.full(vocabulary, before), np.arange(vocabulary))
        for c in np.unique(tables.class_of[:-1]):
            assert abs(p[tables.class_of[:-1] == c].sum() - 1) < 1e-4
    dense = tables.emission(np.arange(vocabulary), np.arange(vocabulary)[::-1])
    tables.dense = None
    assert np.allclose(dense, tables.emission(np.arange(vocabulary), np.arange(vocabulary)[::-1]), atol=1e-5)


def test_hash_of_conversation_digests(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(chat.canonical_turns(df)))
    (r,) = back.select(F.size("turns").alias("n"), "loss_spans", "formatted").collect()
    assert r.n == 2 and [r.formatted[s["start"] : s["end"]] for s in r.loss_spans] == ["b"]


HARD_WORDS = [None, "", " ", "Plain words, of LETTERS. and more", "x<|endoftext|>y <| z", "don't 's it's 'tis a'b'c", "für ÇA été ÷ × ß ÿ µ İ ǆ", "été Å Å", "a b\u0085c　d",
    "done.$$$ %%% a.b,c! (x) [y] #1 3.14 1e9", "w" * 40 + " " + "w" * 41 + " " + "ab" * 300 + ".,", "!" * 40 + " " + "!" * 41, "é" * 20 + " " + "é" * 21, "中文 mixed中文 🎉🎉. naïve", "\x00\x01 \x7f_ ~`^", "a", ".", "É.", "…—“x”"]


def test_words_by_merges_have_the_ids_of_their_library():
    from tokenizers import Tokenizer

    from docmill.llm import tokens
    from docmill.llm.textkernel import column_bytes

    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), tokens.word_ids(path)
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyzABCéèüßñçÀ.,!$'#<|1 ") + ["th", "in", "er", " the ", "\n"]
    texts = HARD_WORDS + ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)]
    for _ in range(2):  # the second time words are known
        flat, begins, hashes, bounds = words.batch(*column_bytes(pa.array(texts)))
        for i, text in enumerate(texts):
            assert flat[begins[i] : begins[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
            assert bounds[i + 1] - bounds[i] == len((text or "").encode().split())


def test_new_plain_words_are_not_given_to_the_library_one_by_one(monkeypatch):
    from docmill.llm import tokens
    from docmill.llm.textkernel import column_bytes

    words = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    given = []
    monkeypatch.setattr(words.encoder, "_words", lambda new: given.append(new) or {w: b"\1\0\0\0" for w in new})
    words.batch(*column_bytes(pa.array(["Neue Wörter, viele.$$$ plainwords", None])))
    assert given == []
    words.batch(*column_bytes(pa.array(["a1b"])))
    assert given == [[b"a1b"]]


def test_gradients_of_blocks_and_of_priors_by_id(monkeypatch):
    rng = np.random.default_rng(8)
    tables, m = small_tables(4), lm.Attention.start()
    x, y, live, _ = lm.windows([rng.integers(0, 49, n).astype(np.uint16) for n in (0, 5, 16, 200)], tables.end)
    inputs, target = tables.input_of[x], tables.class_of[y] * live
    want = lm.gradients(m, inputs, target, live, np.take(tables.prior, x[:, -lm.STRIDE :], axis=0, mode="wrap"))
    monkeypatch.setattr(lm, "BLOCK_WINDOWS", 3)
    for a, b in zip(want, lm.gradients(m, inputs, target, live, tables.prior, x[:, -lm.STRIDE :])):
        assert np.allclose(a, b, atol=1e-6)
