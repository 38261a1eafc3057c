"""The engine: documents in, answers out."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions.embed import Embedder, hashing_embedder, with_vectors
from .operators import prompt, retrieve
from .operators.crawl import crawl
from .operators.generate import Client, generate
from .operators.store import PassageStore
from .sources import files
from .streaming.ingest import passages, sync
from .workspace import saved


class RetrievalEngine:
    """Ingest, rebuild, retrieve and ask over one passage store."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, embedder: Embedder | None = None, client: Callable[[], Client] | None = None) -> None:
        self.spark, self.config, self.client = spark, config or EngineConfig(), client
        self.embedder = embedder or hashing_embedder(self.config.store.dim)
        self.store = PassageStore(spark, self.config.store)
        self.store.ensure()

    def set_client(self, client: Callable[[], Client]) -> None:
        self.client = client

    def _rows(self, docs: DataFrame, corpus_id: str) -> DataFrame:
        return with_vectors(passages(docs, self.config.chunk, corpus_id=corpus_id), self.embedder)

    def ingest(self, docs: DataFrame, corpus_id: str = "default") -> int:
        """Chunk, embed and upsert documents; how many chunks."""
        return self.store.upsert(self._rows(docs, corpus_id))

    def sync(self, docs: DataFrame, corpus_id: str = "default") -> DataFrame:
        """Bring a corpus to the state of ``docs``: chunk and embed what is new or changed, delete what is gone. (source,
        change) of what was different."""
        return sync(docs, self.store, self.config.chunk, corpus_id=corpus_id, seq=int(time.time()), prepared=lambda made: with_vectors(made, self.embedder))

    def _found(self, path: str, recursive: bool, reader, max_pdf_pages: int | None, skip_unreadable: bool) -> DataFrame:
        made = [files.docx_documents(files.files(self.spark, path, ".docx", recursive=recursive), self.config.source)]
        found = files.files(self.spark, path, ".pdf", recursive=recursive)
        pages = saved(files.pdf_pages(found, reader or files.pdf_reader(), ocr=files.ocr_program(), max_pages=max_pdf_pages, config=self.config.source), "pages")
        bad = pages.where("error is not null").select("source", "error")
        if some := bad.limit(5).collect():
            said = f"{bad.count()} PDF files can't be read, among them " + "; ".join(f"{r['source']} ({r['error']})" for r in some)
            if not skip_unreadable:
                raise RuntimeError(f"{said}. To ingest the others, say skip_unreadable")
            warnings.warn(said, stacklevel=3)
        made.append(files.page_documents(pages, self.config.source))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)

    def ingest_path(self, path: str, *, corpus_id: str = "default", recursive: bool = True, reader=None, max_pdf_pages: int | None = None, skip_unreadable: bool = False) -> int:
        """All office documents and PDF files below a path."""
        return self.ingest(self._found(path, recursive, reader, max_pdf_pages, skip_unreadable), corpus_id)

    def ingest_pages(self, pages: DataFrame, *, corpus_id: str = "web") -> int:
        """Fetched pages (url, html)."""
        return self.ingest(files.web_documents(pages, self.config.source), corpus_id)

    def ingest_urls(self, addresses: list[str], *, client=None, corpus_id: str = "web") -> int:
        """Live pages, as far as robots files allow."""
        at = self.spark.createDataFrame([(a,) for a in addresses], "url string")
        return self.ingest(files.fetched_documents(at, client or files.page_client(self.config.source), self.config.source), corpus_id)

    def crawl(self, seed: str, pages: DataFrame | None = None, *, client=None, corpus_id: str = "web", **policy) -> int:
        """The pages that a crawl from ``seed`` accepts, over a table of fetched pages or, without one, over live pages
        as far as robots files allow."""
        policy = {"max_pages": self.config.source.max_crawl_pages, "min_text_len": self.config.source.web_min_text_len, **policy}
        if pages is None:
            policy["get"] = files.live_pages(client or files.page_client(self.config.source), self.config.source)
        found = crawl(self.spark, seed, pages, **policy)
        return self.ingest(files.web_rows(found.select(F.col("url").alias("source"), "title", "text"), self.config.source), corpus_id)

    def rebuild_from_path(self, path: str, *, corpus_id: str = "default", recursive: bool = True, reader=None, collection: str | None = None, force: bool = False, skip_unreadable: bool = False) -> str:
        """A fresh collection of a path's files, promoted when it is whole."""
        return self.store.rebuild(self._rows(self._found(path, recursive, reader, None, skip_unreadable), corpus_id), collection, force=force)

    def retrieve(self, questions: DataFrame, *, k: int | None = None, filters: dict[str, object] | None = None) -> DataFrame:
        """The best passages of each question (query_id, text, role; vector if there is one)."""
        rows = self.store.rows()
        if rows is None:
            raise RuntimeError("nothing is ingested yet")
        c = self.config.retrieval
        asked = with_vectors(questions, self.embedder)
        near = None if filters else self.store.nearest(asked, max(k or c.return_k, c.dense_k))
        return retrieve.hybrid(asked, rows, config=c, filters=filters, k=k, distance=self.config.store.distance, index=self.store.index(), near=near)

    def prompts(self, questions: DataFrame, **options) -> DataFrame:
        """(query_id, context, system, user, payload) of each question."""
        contexts = prompt.context_blocks(self.retrieve(questions, **options), questions)
        at = questions.select("query_id", "text", "role").join(contexts, "query_id")
        at = at.select("query_id", "context", F.lit(prompt.SYSTEM).alias("system"), prompt.user_prompt(F.col("text"), F.col("role"), F.col("context")).alias("user"))
        g = self.config.generator
        return at.withColumn("payload", prompt.chat_payload(prompt.messages(F.col("system"), F.col("user")), g.model, g.temperature))

    def ask(self, questions: DataFrame, **options) -> DataFrame:
        """(query_id, answer, error) of each question."""
        if self.client is None:
            raise RuntimeError("no generator is set")
        said = generate(self.prompts(questions, **options), self.client, self.config.generator)
        return said.select("query_id", prompt.response_text(F.col("body")).alias("answer"), "error")
