import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, secrets, odd spaces,
    and extra columns whose names operators use themselves."""
    key = "AKIA" + "ABCD1234EFGH5678"
    rows = [
        (0, "the cat sat on the mat and the dog ran to the door of the house", "en", "src0", 10),
        (1, "the cat sat on the mat and the dog ran to the door of the house", "en", "src1", 10),
        (2, None, None, None, None),
        (3, "", "en", "src0", 0),
        (4, "  \n\t ", None, "src0", 5),
        (5, "le chat est sur la table et le chien court vers la porte de la maison", "fr", "src2", 10),
        (6, f'password = "s3cr3tvalue99" and {key} here', "en", "src3", 10),
        (7, "token:abc token=deadbeefdeadbeefdeadbeefdeadbeef", "en", None, 10),
        (8, "word " * 6000, "en", "src0", 30000),
        (9, "a  b\n c\td 日本語 😀 naïve Éa's it's 12,345.", None, "src4", 10),
        (10, "12345 !!! 678", None, "src0", 13),
        (6, f'password = "s3cr3tvalue99" and {key} here', "en", "src3", 10),
        (None, "the cat sat on the mat and the dog ran to the door of the house", None, "src0", 10),
        (None, None, None, None, None),
    ]
    base = spark.createDataFrame(rows, SCHEMA)
    return base.withColumn("score", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("key", F.lit(2)).withColumn("fp", F.lit(3)).withColumn("row", F.lit(4)).withColumn("slot", F.lit(5))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
