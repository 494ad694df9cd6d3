"""Line-first cleaning: rules judge each line, failed lines go, and a document that loses too much text is rejected.

A line with a word fails
  navigation   if at least a fifth of its words are bare separators, at least half are links, or it has 4 words or more of
               which over two thirds begin with a capital letter,
  symbols      if it has more than one symbol for every two words,
  shouting     if it has at least 4 capitals A-Z and more capitals than small letters a-z,
  punctuation  if neither of its last two words ends in closing punctuation (of any script),
  boilerplate  if it has one of the stock phrases below.
Lines without a word neither pass nor fail and stay. A document is rejected if over ``max_lost`` per cent of its word
characters were in failed lines, or by the base rules (under 20 words; over 30 % of the words in repeated 8-word windows).

Defined results: a null or empty text has no words and fails the base rules; its cleaned text stays null or empty. Rows are
judged one by one, so repeated rows, null ids and extra columns are kept as they are; columns named like the results are
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import table

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Words that only separate menu entries.
SEPARATORS = ["|", ">", "»", "•", "·", "/", "-", "–"]
#: What a sentence may end in.
CLOSING = ".!?:;…\"')]»”’›。！？：；」』）؟۔।॥"
#: Capital letters that a word of a menu begins with.
CAPITAL = "[A-ZÀ-ÖØ-Þ]"
#: Stock phrases by language, looked up in the line with A-Z in lower case.
BOILERPLATE = [
    # English
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "sign up for", "subscribe to our",
    "click here", "enable javascript", "skip to content", "share this", "we use cookies", "accept cookies", "back to top", "log in to", "follow us on", "powered by",
    # German
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "nutzungsbedingungen", "impressum", "newsletter abonnieren", "hier klicken", "javascript aktivieren",
    "zum inhalt springen", "wir verwenden cookies", "nach oben",
    # French
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "abonnez-vous", "cliquez ici", "activer javascript", "aller au contenu",
    "nous utilisons des cookies", "haut de page",
    # Spanish
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "suscríbete", "haga clic aquí", "habilitar javascript", "saltar al contenido",
    "utilizamos cookies", "volver arriba",
]

RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_failed_lines", "lost_chars")]
    + [T.StructField("clean_text", T.StringType())]
)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur at least twice, the first occurrence included.

    Windows are numbered exactly: pairs of numbered halves are numbered again, so no hash can collide.
    """
    if len(words) < size + 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    span = 1
    while True:
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        span *= 2
        if len(counts) == len(ids):  # no window of this span occurs twice, so no longer one does
            return 0
        if span == size:
            break
    hit = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def line_fails(line: str, words: list[bytes], phrases: list[bytes] | None = None) -> bool:
    """phrases: those of the stock phrases that the text has at all; None: not looked up yet."""
    n, raw = len(words), line.encode()
    if 5 * sum(map(_SEPARATORS.__contains__, words)) >= n:
        return True
    if (b"://" in raw or b"www." in raw) and 2 * sum(b"://" in w or w.startswith(b"www.") for w in words) >= n:
        return True
    if 2 * len(SYMBOLS.findall(line)) > n:
        return True
    if not (words[-1].endswith(_CLOSING) or n > 1 and words[-2].endswith(_CLOSING)):
        return True
    upper = len(raw) - len(raw.translate(None, _UPPER))
    if n >= 4 and 3 * (upper + raw.count(b"\xc3")) > 2 * n and 3 * len(_CAPITALS.findall(line)) > 2 * n:
        return True
    if upper >= 4 and upper > len(raw) - len(raw.translate(None, _LOWER)):
        return True
    low = raw.lower()
    return any(p in low for p in (_PHRASES if phrases is None else phrases))


_SEPARATORS = {s.encode() for s in SEPARATORS}
_PHRASES = [p.encode() for p in BOILERPLATE]
_CAPITALS = re.compile(rf"(?<![^\x20\x09-\x0D]){CAPITAL}")
_CLOSING = tuple(c.encode() for c in CLOSING)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def judge(text: str | None, max_lost: int) -> tuple:
    if text is None:
        return 0, 0, 0, 0, 0, True, False, 0, 0, 0, None
    lines, seen, kept = text.split("\n"), set(), []
    words: list[bytes] = []
    low = text.encode().lower()
    phrases = [p for p in _PHRASES if p in low]
    chars = dups = n_lines = failed = lost = 0
    for line in lines:
        own = line.encode().split()
        if own:
            n_lines += 1
            own_chars = sum(map(len, b"".join(own).decode().split("\0"))) + b"".join(own).count(b"\0")
            chars += own_chars
            words += own
            dups += line in seen
            seen.add(line)
            if line_fails(line, own, phrases):
                failed += 1
                lost += own_chars
                continue
        kept.append(line)
    n, repeated = len(words), repeated_words(words)
    base_failed = n < 20 or 100 * repeated > 30 * n
    verdict = not base_failed and 100 * lost <= max_lost * chars
    return n, chars, len(SYMBOLS.findall(text)), dups, repeated, base_failed, verdict, n_lines, failed, lost, "\n".join(kept)


def quality_rules(docs: DataFrame, text: str = "text", max_lost: int = 40) -> DataFrame:
    """Adds the measures, ``base_failed``, ``kept`` and ``clean_text`` to every row."""

    @F.pandas_udf(RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, max_lost) for t in texts], columns=RESULT.names)

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT.names]
    once = judged.asNondeterministic()  # else a filter on the verdict is pushed below and judges every text twice
    own = "_judged"
    while own in docs.columns:
        own += "_"
    return docs.select(*rest, once(F.col(text)).alias(own)).select(*rest, f"{own}.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text", "clean_text")


def oracle_sql() -> dict[str, str]:
    quoted = ", ".join("'" + s.replace("'", "''") + "'" for s in SEPARATORS)
    closing = ", ".join("'" + c.replace("'", "''") + "'" for c in CLOSING)
    phrases = " OR ".join(f"contains(low, '{q}')" for q in [p.replace("'", "''") for p in BOILERPLATE])
    word = r"[^\x20\x09-\x0D]+"
    sql = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
m AS (
  SELECT doc_id, line, pos, regexp_extract_all(line, '{word}') AS w, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS copy
  FROM l WHERE regexp_matches(line, '{word}')),
j AS (
  SELECT doc_id, copy, length(array_to_string(w, '')) AS chars,
    5 * len(list_filter(w, lambda x: x IN ({quoted}))) >= len(w)
    OR 2 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(w)
    OR 2 * len(list_filter(w, lambda x: contains(x, '://') OR starts_with(x, 'www.'))) >= len(w)
    OR len(list_filter(w[greatest(len(w) - 1, 1):], lambda x: right(x, 1) IN ({closing}))) = 0
    OR (len(w) >= 4 AND 3 * len(list_filter(w, lambda x: regexp_matches(x, '^{CAPITAL}'))) > 2 * len(w))
    OR (length(regexp_replace(line, '[^A-Z]', '', 'g')) >= 4 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^a-z]', '', 'g')))
    OR {phrases} AS failed
  FROM m),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE copy > 1) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_failed_lines,
    sum(CASE WHEN failed THEN chars ELSE 0 END) AS lost_chars, sum(chars) AS word_chars
  FROM j GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept
FROM f"""
    return {"op1_quality_rules": sql}
