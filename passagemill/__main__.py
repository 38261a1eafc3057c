"""python -m passagemill --docs_dir DIR --url URL --question TEXT --role ROLE: ingest files, then show a question's prompt, or its
answer if a generator is configured."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from .config import EngineConfig, api_key
from .engine import RetrievalEngine
from .operators.generate import http_client


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="passagemill")
    ask.add_argument("--docs_dir")
    ask.add_argument("--pages", help="a Parquet table of fetched pages (url, html)")
    ask.add_argument("--url", action="append", default=[], help="a live page; may be given several times")
    ask.add_argument("--question")
    ask.add_argument("--role", default="developer")
    ask.add_argument("--ocr", action=argparse.BooleanOptionalAction, default=None)
    said = ask.parse_args(argv)
    spark = SparkSession.builder.appName("passagemill").getOrCreate()
    config = EngineConfig.from_env()
    if said.ocr is not None:
        config = dataclasses.replace(config, source=dataclasses.replace(config.source, enable_ocr=said.ocr))
    key = api_key()
    engine = RetrievalEngine(spark, config, client=http_client(config.generator, key) if key and config.generator.base_url else None)
    if said.docs_dir:
        print(engine.ingest_path(said.docs_dir), "chunks ingested")
    if said.url:
        print(engine.ingest_urls(said.url), "chunks ingested")
    if said.pages:
        print(engine.ingest_pages(spark.read.parquet(said.pages)), "chunks ingested")
    if said.question:
        questions = spark.createDataFrame([(0, said.question, said.role)], "query_id long, text string, role string")
        out = engine.ask(questions).first() if engine.client else engine.prompts(questions).first()
        print(out["answer"] or out["error"] if engine.client else out["user"])


if __name__ == "__main__":
    main()
