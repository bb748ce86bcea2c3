import pytest
from pyspark.sql import functions as F

from litsieve.functions.stemming import porter, stem_word
from litsieve.functions.stopwords import default_stop_words
from litsieve.functions.text import normalize_text, tokens

SAMPLE = "12.5% of a@b1.org <b>x</b> +/- 1.2.3 e-mail A=B^C\n"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_tagged_steps_in_order(spark):
    found = one(spark, SAMPLE, normalize_text(F.col("text"), "tagged"))
    # digits are words before e-mail addresses are looked for
    assert found == "percentage of emailadd org x plusminus anynumber email a b c "


def test_plain_steps(spark):
    found = one(spark, "12.5% of e-mail\fNEXT\n<b>", normalize_text(F.col("text"), "plain"))
    assert found == " of email next b"


@pytest.mark.parametrize("preset", ["plain", "tagged"])
def test_line_ends_equal_spaces_for_tokens(spark, preset):
    text = "alpha\nbeta<i\nj>gamma 1\n.5 delta\fepsi-\nlon"
    spaced = one(spark, text, normalize_text(F.col("text"), preset))
    assert one(spark, text, tokens(F.col("text"), preset)) == [w for w in spaced.split() if len(w) >= 3]


def test_stop_words_after_punctuation(spark):
    found = one(spark, "The cat, don't stop the DOG", normalize_text(F.col("text"), stop_words=default_stop_words()))
    assert found == "cat dont stop dog"


def test_tokens_need_three_characters(spark):
    assert one(spark, "an ant is éée no", tokens(F.col("text"))) == ["ant", "éée"]
    assert one(spark, "", tokens(F.col("text"))) == []


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"),
        ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
        ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"),
        ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("radicalli", "radic"),
        ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"),
        ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"),
        ("formaliti", "formal"), ("sensitiviti", "sensit"), ("triplicate", "triplic"),
        ("formative", "form"), ("formalize", "formal"), ("electrical", "electr"), ("hopeful", "hope"),
        ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"),
        ("airliner", "airlin"), ("adjustable", "adjust"), ("irritant", "irrit"),
        ("replacement", "replac"), ("adjustment", "adjust"), ("dependent", "depend"),
        ("adoption", "adopt"), ("communism", "commun"), ("activate", "activ"), ("homologous", "homolog"),
        ("effective", "effect"), ("bowdlerize", "bowdler"), ("probate", "probat"), ("rate", "rate"),
        ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"),
        ("oscillators", "oscil"), ("yes", "ye"), ("at", "at"),
    ],
)
def test_porter_examples(word, stem):
    assert porter(word) == stem


def test_stemming_in_spark(spark):
    words = spark.createDataFrame([("ponies",), (None,), ("relational",)], "w string")
    assert [r[0] for r in words.select(stem_word(F.col("w"))).collect()] == ["poni", None, "relat"]
    assert one(spark, "The ponies, agreed", normalize_text(F.col("text"), stem=True)) == "the poni agre"
    assert one(spark, "ponies cats", tokens(F.col("text"), stem=True)) == ["poni", "cat"]


def test_stemming_keeps_null_texts(spark):
    texts = spark.createDataFrame([("relational ponies",), (None,), ("",)], "text string")
    assert [r[0] for r in texts.select(normalize_text(F.col("text"), stem=True)).collect()] == ["relat poni", None, ""]
