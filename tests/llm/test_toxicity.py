import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("readroute.llm.queries")
sys.path.insert(0, str(Path(__file__).parent))

import held_out
from readroute.llm import charmodel, phrases, scorer, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.exists(charmodel.VOCABULARIES[0]) or not os.path.isdir(SF), reason="vocabularies or tables are not here")


@pytest.fixture(scope="module")
def models(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), "text")


def scores(spark, models, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.score for r in toxicity.score(df, "text", models).orderBy("id").collect()]


def test_fresh_lines(spark, models):
    """Written after the frames and settings were final, and scored once."""
    found = [s >= toxicity.CASE for s in scores(spark, models, held_out.FRESH_ABUSIVE)]
    false = [s >= toxicity.CASE for s in scores(spark, models, held_out.FRESH_PLAIN)]
    print("fresh:", len(found), "recall", np.mean(found), len(false), "false", np.mean(false))
    assert np.mean(found) > 3 * np.mean(false)


def test_held_out_lines(spark, models):
    """None of these lines is learned from, but they were known."""
    learned = {f for k in (*phrases.KINDS, "plain") for f in phrases.frames(k)}
    foul, fine = held_out.ABUSIVE_LINES, held_out.PLAIN_LINES
    assert len([x for x in foul + fine if x.lower() in learned]) <= 1
    found = [s >= toxicity.CASE for s in scores(spark, models, foul)]
    false = [s >= toxicity.CASE for s in scores(spark, models, fine)]
    print("held out: recall", np.mean(found), "false", [x for x, f in zip(fine, false) if f], "missed", [x for x, f in zip(foul, found) if not f])
    assert np.mean(found) >= 0.9
    assert np.mean(false) <= 0.05


def test_wording_met_in_tables(spark, models):
    """Constructions that a round's tables held and its frames did not, in other
    words, and plain lines taken for them."""
    foul = ["the intern is a rotten little bootlicker", "what a slimy sack of garbage our boss turned out to be", "typical pensioners, locusts, every single one", "tomorrow they find my colleague in the lake", "he could hardly wait to mount his neighbour while the others watch", "I drag you behind my van"]
    fine = ["Comparamos fat con protein", "Loser bracket, team 4", "refugees, women and old people are the three groups of table 2", "このセルを実行してください"]
    learned = {f for k in (*phrases.KINDS, "plain") for f in phrases.frames(k)}
    assert not learned & {x.lower() for x in foul + fine}
    assert [x for x, s in zip(foul, scores(spark, models, foul)) if s < toxicity.CASE] == []
    assert [x for x, s in zip(fine, scores(spark, models, fine)) if s >= toxicity.CASE] == []


def test_marks_tell_pairs_of_a_bucket_apart():
    """A corpus has far more pairs than the table has buckets; with 256 marks
    one strange pair in some thousand took the weight of another."""
    keys = (np.uint64(5) << np.uint64(64 - scorer._BITS)) + np.random.default_rng(1).integers(0, 1 << (64 - scorer._BITS), 20_000, np.uint64)
    at, marks = scorer._place(keys)
    assert set(at) == {5} and len(set(marks.tolist())) > 10_000


def test_frames_left_out(models):
    """Recall on every fifth frame when it is not learned from. Many of these
    are the only ones of their language or wording, so this is a floor."""
    model = models[0]
    restorer = toxicity.Restorer(model)
    weights = scorer.fit(restorer.words, [], toxicity.ordinary(model), leave_out=2)
    words, rng, every = scorer.Words(), random.Random(1), []
    for kind, good in (*((k, True) for k in phrases.KINDS), ("plain", False)):
        texts = [restorer.words(phrases.fill(f, rng)) for i, f in enumerate(phrases.frames(kind)) if i % 5 == 2]
        got = [s >= toxicity.CASE for _, s, _, _ in scorer._worst(weights, words, [[words(w) for w in t] for t in texts])]
        print("left out", kind, len(got), np.mean(got))
        every += got if good else []
        assert good or np.mean(got) <= 0.2
    assert np.mean(every) >= 0.45


def test_a_passage_is_found_anywhere(spark, models):
    filler = "plain words about river gauges and bakery orders\n" * 4000
    foul = ["what a stup1d b.a.s.t.a.r.d you are", "you are a w*******s l***r"]
    texts = [filler + foul[0] + "\n" + filler, filler, filler.replace("\n", " ") + foul[1] + " " + filler.replace("\n", " ")]
    texts[0] += "aZ09+" * 200_000 + "\\u00e8" * 50_000
    assert [s >= toxicity.CASE for s in scores(spark, models, texts)] == [True, False, True]


def test_tokens_of_any_length(spark, models):
    long = ["you_worthless_piece_of_shit_go_kill_yourself_right_now_and_never_return", "what an idio" + "o" * 60 + "t you are", "-".join(["plain"] * 3000) + "-go-kill-yourself-" + "-".join(["plain"] * 3000), "youareaworthlessmoron"]
    fine = ["-".join(["plain"] * 30), "a1b2" * 20, "=" * 80, "kill_the_worker_process_and_break_the_loop"]
    got = scores(spark, models, long + fine)
    assert [t[:60] for t, s in zip(long, got) if s < toxicity.CASE] == []
    assert [t for t, s in zip(fine, got[len(long) :]) if s >= toxicity.CASE] == []


def test_noise_is_read(models):
    restorer = toxicity.Restorer(models[0])
    cases = {
        "fu\u200bck": "fuck", "F.U.C.K": "fuck", "b4st4rd": "bastard", "naaaaked": "naked", "p***y": "pussy", "p\u00e1thetic": "pathetic", "\uff46uck": "fuck", "\u0441unt": "cunt",
        "pvssy": "pussy", "iddiot": "idiot", "azzhole": "asshole", "a$$hole": "asshole", "sh!t": "shit", "1d10t": "idiot", "l***r": "loser", "k i l l": "kill", "you're": "you are", "don't": "do not",
    }
    assert {k: " ".join(restorer.words(k)) for k in cases} == cases
    for plain in ("root", "bitte", "hoot", "rapped", "class", "pizza", "matrix", "foot", "value", "utf8", "md5", "h5py"):
        assert restorer.words(plain) in ([plain], ["<num>"]), plain


def test_the_model_is_of_letters(models):
    """A string of letters that is no word has a cost too, a likelier one less."""
    model = models[0]
    assert "blorting" not in model.words
    assert model.as_it_stands("blorting") < model.as_it_stands("tgnlbori")
    # Read in the open: no list holds the word.
    assert model.decode(["bl0rting"])["bl0rting"][0] == "blorting"
    total = np.exp(-model.cost.astype(float)).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-3)


def test_best_passages_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 9, 6)
        value = rng.normal(-0.3, 1, sizes.sum())
        starts = np.cumsum(sizes) - sizes
        best, a, b = scorer.best_passages(value, starts)
        for k, (s, n) in enumerate(zip(starts, sizes)):
            want = max(value[x : y + 1].sum() for x in range(s, s + n) for y in range(x, s + n))
            assert np.isclose(best[k], want) and np.isclose(value[a[k] : b[k] + 1].sum(), want)


def test_empty_null_and_names(spark, models):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, "you fucking idiot", "b"), (4, "you fucking idiot", None)], "id int, text string, `s.x` string")
    got = toxicity.score(df, "text", models)
    assert [r.score >= toxicity.CASE for r in got.orderBy("id").collect()] == [False] * 3 + [True] * 2
    assert toxicity.score(df.limit(0), "text", models).count() == 0
    rates = {r["s.x"]: (r.n_docs, r.n_flagged, r.insult_rate) for r in toxicity.rates(got, "s.x").collect()}
    assert rates == {"a": (2, 0, 0.0), "b": (2, 1, 0.5), None: (1, 1, 1.0)}
    with pytest.raises(ValueError):
        toxicity.score(df.withColumnRenamed("id", "score"), "text", models)
    # Without texts to sample, the models stand on the passages alone.
    assert toxicity.score(df.filter("id = 4"), "text").filter(F.col("score") >= toxicity.CASE).count() == 2
