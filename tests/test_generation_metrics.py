"""Stems against published pairs, ROUGE and METEOR against plain code."""

import itertools
import random

from sparkloom.functions.stemming import stem
from sparkloom.operators import evaluation as E

PAIRS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
radicalli radic vileli vile vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr hopeful hope goodness good revival reviv allowance allow airliner airlin gyroscopic gyroscop adjustable adjust irritant irrit
replacement replac adoption adopt homologou homolog communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
dies die died die played play say say geology geolog fully fulli cried cri dying die news news by by yellow yellow""".split()


def test_published_stems():
    assert [stem(a) for a in PAIRS[::2]] == PAIRS[1::2]


def test_stems_of_odd_words():
    assert [stem(w) for w in ("", "a", "y", "yy", "ing", "ed", "e", "123", "éé", "x1ing", "s", "ss", "ies", "eed")] == ["", "a", "y", "yy", "ing", "ed", "e", "123", "éé", "x1ing", "s", "ss", "i", "eed"]


def exhaustive(hyp, ref):
    """Most exact pairs, then fewest chunks, over all alignments of few words."""
    best = (0, 0)
    for n in range(min(len(hyp), len(ref)), 0, -1):
        for left in itertools.combinations(range(len(hyp)), n):
            for right in itertools.permutations(range(len(ref)), n):
                if all(hyp[i] == ref[j] for i, j in zip(left, right)):
                    found = (-n, E._chunks(list(zip(left, right))))
                    best = min(best, found)
        if best != (0, 0):
            return best
    return best


def test_fewest_chunks_against_all_alignments():
    rng = random.Random(8)
    for _ in range(60):
        hyp, ref = ([rng.choice("ab.") for _ in range(rng.randint(0, 6))] for _ in range(2))
        pairs = E._fewest(list(enumerate(hyp)), list(enumerate(ref)), [], 40)
        assert (-len(pairs), E._chunks(pairs)) == exhaustive(hyp, ref), (hyp, ref)


def test_meteor_scores():
    assert E.meteor_score("", "a") == E.meteor_score(None, None) == 0.0
    assert abs(E.meteor_score("the cat sat", "the cat sat") - (1 - 0.5 / 27)) < 1e-12
    assert E.meteor_score("ponies run", "pony running") > 0.9 * 0.5  # by stems
    assert E.meteor_score("a b a c", "a c x a b", fewest=True) > E.meteor_score("a b a c", "a c x a b") - 1e-12
    assert E._paired([(0, "x"), (1, "x")], [(5, "x"), (7, "x"), (9, "x")]) == [(1, 9), (0, 7)]


def test_rouge_of_pairs(spark):
    pairs = spark.createDataFrame([("The ponies, running!", "a pony RUNS on"), (None, "x"), ("", "")], "prediction string, reference string")
    r = E.rouge_stemmed(pairs).first()
    assert abs(r.rouge1_p - (2 / 3) / 3) < 1e-9 and abs(r.rouge1_r - (2 / 4) / 3) < 1e-9 and abs(r.rouge2_p - (1 / 2) / 3) < 1e-9 and abs(r.rougeL_r - (2 / 4) / 3) < 1e-9
    assert E.meteor(pairs.selectExpr("reference AS prediction", "reference"), fewest=True).first().meteor > 0
    assert E.rouge_stemmed(pairs.limit(0)).first().rouge1_f is None
