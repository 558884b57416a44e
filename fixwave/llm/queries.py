"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.llm import lines, phrases
from fixwave.llm.common import Scratch, documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.packing import pack

    pieces = pack(documents(spark, sf_dir), tokenizer_path(), 2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.token_files import digest, read_tokens, write_tokens

    path = Scratch(spark, "tokens").path("files")
    write_tokens(documents(spark, sf_dir), path, tokenizer_path(), end_id=0)
    return digest(read_tokens(spark, path))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.repeats import digest, remove

    return digest(remove(documents(spark, sf_dir), length=200))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.secrets import digest, find

    return digest(find(documents(spark, sf_dir)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.quality import score

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.pii import digest, find

    return digest(find(documents(spark, sf_dir)))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.jaccard import classes

    return classes(documents(spark, sf_dir), percent=80, size=5)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.chat import format_chats

    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.media import features, read_archives, write_archives

    folder = Scratch(spark, "media").path("archives")
    archives = write_archives(documents(spark, sf_dir), folder, width=192)
    return features(read_archives(spark, folder, archives), width=192)


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.leaks import find

    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.runs import find

    return find(documents(spark, sf_dir), fold=True)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.phrases import mine

    return mine(documents(spark, sf_dir), longest=4, least=30, top=2000)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixwave.llm.lines import digest, remove

    return digest(remove(documents(spark, sf_dir), documents=3, length=20))


QUERIES = {f.__name__: f for f in (op1_packing, op2_repeats, op3_secrets, op4_quality, op5_pii, op6_token_files, op7_jaccard, op8_chat, op9_media, op10_leaks, op11_runs, op12_phrases, op13_lines)}
ORACLE_SQL: dict[str, str] = {"op12_phrases": phrases.SQL, "op13_lines": lines.SQL}
