import random

import pytest

LANGUAGES = {
    "en": "the of and to in that is was for on with as be by at this have from they not but".split(),
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es".split(),
    "fr": "le de la les et des un une du en que est pour qui dans par sur au plus pas ne".split(),
}


def prose(rng: random.Random, lang: str = "en", words: int = 60) -> str:
    return " ".join(rng.choice(LANGUAGES[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


@pytest.fixture
def rng():
    return random.Random(3)


@pytest.fixture
def docs(spark):
    """(rows of id and text, maybe more) -> DataFrame with columns that clash with the operators' own names."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        for name in ("_id", "_text", "_kept", "_doc", "_lang", "fp", "key", "bucket", "k1", "k2", "spans", "g"):
            df = df.withColumn(name, F.lit(7))
        return df

    return make
