import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analyzers as Z


@pytest.fixture
def one(spark):
    def run(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    return run


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "formality": "formal", "sensibility": "sensibl",
    "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


@pytest.mark.parametrize("word", STEMS)
def test_published_stems(word):
    assert Z.porter(word) == STEMS[word]


def test_tokenizers(one):
    assert one(Z.whitespace, "  a  B-c\n") == ["a", "B-c"]
    assert one(Z.char_bigrams, "ab 日本語 x_1") == ["ab", "日本", "本語", "語", "x_1"]
    assert one(Z.simple, "It's 5 O'Clock") == ["it", "s", "o", "clock"]
    assert one(Z.standard, "The running dogs are at the stations") == ["run", "dog", "station"]
    assert one(Z.whitespace, None) is None and one(Z.standard, "") == [] and one(Z.standard, None) is None


def test_filters(one):
    assert one(lambda t: Z.edge_grams(Z.tokens(t), 1, 3), "abcd x") == ["a", "ab", "abc", "x"]
    assert one(lambda t: Z.gram_filter(Z.tokens(t), 2, 3), "abcd x") == ["ab", "bc", "cd", "abc", "bcd"]
    book = Z.synonym_groups(["Car", "auto"], ["car", "vehicle"])
    assert one(lambda t: Z.expand_synonyms(Z.tokens(t), book), "my car") == ["my", "auto", "vehicle", "car"]


def test_languages(one):
    assert one(Z.detect_language, "the cat is not in the house and that is it") == "en"
    assert one(Z.detect_language, "el gato no es de la casa y se va por los campos") == "es"
    assert one(Z.detect_language, "die Katze ist nicht in dem Haus und das ist auch gut") == "de"
    assert one(Z.detect_language, "le chat est dans la maison et les enfants ne sont pas") == "fr"
    assert one(Z.detect_language, "日本語のテキスト") == "ja"
    assert one(Z.detect_language, "中文文本") == "zh"
    assert one(Z.detect_language, "") == "en"


def test_fragments_keep_the_best_pieces_in_order(one):
    filler = "word " * 40
    text = f"cat one. {filler}a cat and a CAT here {filler}{filler}concat {filler}last cat cat cat"
    got = one(lambda t: Z.fragments(t, ["cat"], 50, 2), text)
    parts = got.split(" ... ")
    assert len(parts) == 2 and [p.count("<b>") for p in parts] == [2, 3]
    assert all(len(re.sub("</?b>", "", p)) <= 50 for p in parts)
    assert one(lambda t: Z.fragments(t, [], 4), "abcdefgh") == "abcd"
