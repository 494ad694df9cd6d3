"""Calls of outside models over Arrow batches: embedding, structured completion, the brief writer. The model is a callable that
the caller gives; the built-in ones need nothing outside and are deterministic."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
MODEL = "hash-64"


class FatalModelError(Exception):
    """The model can't answer any request: no further call makes sense."""


def hashing_embedder(texts: list[str]) -> list[list[float] | None]:
    """Signed counts of hashed words, as a unit vector; None for a text without words."""
    out: list[list[float] | None] = []
    for t in texts:
        v = np.zeros(DIMENSIONS)
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
        n = float(np.linalg.norm(v))
        out.append([float(x) for x in v / n] if n else None)
    return out


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float] | None]] = hashing_embedder, dimensions: int = DIMENSIONS, batch: int = 64, key: str = "id", text: str = "text") -> DataFrame:
    """(key, v, status): a vector of the wrong size or a failed batch is null, and the status says why. After a ``FatalModelError``
    a task calls no more: the rows of that call are "fatal", those after it "not tried"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = False  # for all batches of the task
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                if broken:
                    yield pd.DataFrame([(k, None, "not tried") for k in own["id"]], columns=["id", "v", "status"], dtype=object)
                    continue
                try:
                    got = embedder([t or "" for t in own["text"]])
                    rows_ = [(k, v if v is not None and len(v) == dimensions else None, "ok" if v is not None and len(v) == dimensions else "empty" if v is None else "wrong size") for k, v in zip(own["id"], got)]
                except FatalModelError:
                    broken = True
                    rows_ = [(k, None, "fatal") for k in own["id"]]
                except Exception as e:  # noqa: BLE001  a failed call leaves its rows without a vector
                    rows_ = [(k, None, f"failed: {type(e).__name__}") for k in own["id"]]
                yield pd.DataFrame(rows_, columns=["id", "v", "status"], dtype=object)

    from pyspark.sql import functions as F

    return rows.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, v array<float>, status string")


def heuristic_client(title: str, body: str) -> str:
    """JSON as a model would answer: the first sentence as the summary, no opinion on the claim."""
    first = re.split(r"(?<=[.!?])\s", body.strip(), maxsplit=1)[0]
    return json.dumps({"summary": first, "category": "other", "tags": [], "orgs": [], "claim_status": "reported", "status_reason": ""})


def llm_enrich(rows: DataFrame, client: Callable[[str, str], str] = heuristic_client, body_chars: int = 1500) -> DataFrame:
    """rows: id, title, summary. (id, raw, prompt_tokens, completion_tokens, status); a row that fails does not touch the others, but after
    a ``FatalModelError`` a task calls no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = False
        for pdf in batches:
            out = []
            for k, title, body in zip(pdf["id"], pdf["title"], pdf["summary"]):
                title, body = title or "", (body or "")[:body_chars]
                if broken:
                    out.append((k, None, 0, 0, "not tried"))
                    continue
                try:
                    raw = client(title, body)
                    out.append((k, raw, (len(title) + len(body)) // 4, len(raw) // 4, "ok"))
                except FatalModelError:
                    broken = True
                    out.append((k, None, 0, 0, "fatal"))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, 0, 0, f"failed: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["id", "raw", "prompt_tokens", "completion_tokens", "status"], dtype=object)

    return rows.select("id", "title", "summary").mapInPandas(run, "id long, raw string, prompt_tokens long, completion_tokens long, status string")


def brief_writer(candidates: DataFrame, day: str, writer: Callable[[list[dict]], dict] | None, most: int = 25) -> DataFrame:
    """(day, title, body_markdown, article_ids) of the day's brief; no row without candidates.

    writer gets at most ``most`` candidates (the digest's own limit, so the collect is bounded) and answers title, intro and items
    (headline, body, article_ids). Without a writer, or if it raises ``FatalModelError``, the brief is made from the ranking alone;
    any other error is raised.
    """
    from tidewire.operators.feed import digest_fallback
    from tidewire.operators.jobs import digest_render

    ids = F.transform(F.split("article_ids", ","), lambda k: k.try_cast("bigint")).alias("article_ids")
    plain = digest_fallback(candidates).where("article_ids <> ''").select(F.lit(day).alias("day"), "title", "body_markdown", ids)
    if writer is None:
        return plain
    given = [r.asDict() for r in candidates.orderBy(F.desc("impact"), F.desc("credibility"), "id").limit(most).collect()]
    if not given:
        return plain
    try:
        said = writer(given)
    except FatalModelError:
        return plain
    items = [(x["headline"], x["body"], [int(k) for k in x["article_ids"]]) for x in said["items"]]
    shape = "day string, title string, intro string, items array<struct<headline: string, body: string, article_ids: array<bigint>>>"
    return digest_render(candidates.sparkSession.createDataFrame([(day, said["title"], said["intro"], items)], shape), candidates)
