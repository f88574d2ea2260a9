"""URL filters: host and path rules, and logistic regression on hashed character n-grams of host and path.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest fitting
rule wins.  Urls without a rule are judged by the classifier.  Its features are the character trigrams of
``^host$`` and of ``^path$``, hashed by a polynomial of their code points to ``BUCKETS`` buckets for each of
the two; a url's score is the sum of the weights of its trigrams, so a url without any gets 0 and passes.  Weights are whole numbers
(millionths), so a score does not depend on the order of summation.

The weights are trained at the first use from ``LABELLED``, a small table of invented urls, by full-batch
gradient descent; the table and the number of steps are fixed, so the weights are always the same.

Defined results: null and empty urls and urls without ``://`` have an empty host and path and no rule, and get the
verdict allow; repeated rows are judged each; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayquad.llm.common import ready, table

#: A prime below 2048, for host and path each.
BUCKETS = 2039
SCALE = 1_000_000
#: (rule, block?) as the contract of op1 states them (fixed values).
RULES = (("net/", True), ("example.net/en/", False), ("example.com/de/", True), ("org/fr/", False))
#: The small labelled url table: invented sites to allow (0) and to block (1), in both classes with the same
#: subdomains, endings and paths in turn, so that only what a site calls itself tells the classes apart.
SITES = {
    0: "town-council garden-notes library toolkit-docs weather museum school lentil-kitchen cityhall science cycling letters-archive health-advice railways bookreview trails theatre encyclopedia "
    "university thornton northern tierheim journal orchestra bakery observatory harbour birdwatch opendata eye-clinic tennis-club poetry carpentry inthern onthere chess geology fahrplan nursery "
    "astronomy heritage linguistics rowing mountain-huts weaving parliament beekeeping stadtarchiv bibliotheque ayuntamiento thandor erenst tiongard shoreline anterior wherton hestia oulens",
    1: "free-casino-bonus xxx-videos cheap-pills best-poker-slots adult-cams win-free-iphone fast-cash-loan replica-watches torrent-warez hot-singles casino777 pills4less porn-tube click-ads "
    "betting-tips crack-serials sexy-cams bitcoin-doubler spam-links spamdexing link-farm content-farm ads-server ad-tracker track-pixel casino casino-royal online-casino big-win-slots cheap-viagra "
    "pills-direct cheap-meds adult-chat x-adult xxx free-bets bets-online sports-betting payday-loans quick-cash warez-free free-prize win-prizes porn escort-girls forex-win weight-loss-pills "
    "fake-watches keygen-download spam jackpot-play poker-win adult-dating viagra-shop spam-blast ads-clicks track-ads cash-bonus",
}
SUBDOMAINS, ENDINGS = ("", "www.", "m.", "blog."), ("example", "example.com", "example.org", "example.net", "example.edu")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2", "/{}", "/en/{}#top", "/posts/{}.html", "/en/{}?utm_source=feed", "/news/{}/story", "/item/{}", "/")
LABELLED = tuple(
    (f"http{'s' * (k % 2)}://{SUBDOMAINS[k % 4]}{site}.{ENDINGS[k % 5]}{PATHS[k % 11].format(137 * k + 11)}", label) for label, sites in SITES.items() for k, site in enumerate(sites.split())
)
PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RESULT = "host string, path string, rule string, verdict string, score long"


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    found = PARTS.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def buckets(host: str, path: str) -> np.ndarray:
    """Buckets of the trigrams; the path's follow the host's."""
    out = []
    for k, text in enumerate((f"^{host}$", f"^{path}$")):
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        out.append(((c[:-2] * 257 + c[1:-1]) * 257 + c[2:]) % BUCKETS + k * BUCKETS)
    return np.concatenate(out)


@lru_cache(maxsize=1)
def weights(steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights in millionths."""
    x = np.zeros((len(LABELLED), 2 * BUCKETS))
    for row, (url, _) in enumerate(LABELLED):
        np.add.at(x[row], buckets(*split(url)), 1)
    y = np.array([label for _, label in LABELLED], float)
    w = np.zeros(2 * BUCKETS)
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(x @ w))) - y
        w -= rate * (x.T @ gap / len(y) + ridge * w)
    return np.rint(w * SCALE).astype(np.int64)


def rule_of(host: str, path: str, rules: Sequence[tuple[str, bool]]) -> tuple[str, bool] | None:
    """The longest rule that fits; of equally long ones the first."""
    fit = [(r, block) for r, block in rules if _fits(host, path, r)]
    return max(fit, key=lambda x: len(x[0])) if fit else None


def _fits(host: str, path: str, rule: str) -> bool:
    name, slash, rest = rule.partition("/")
    return (host == name or host.endswith("." + name)) and path.startswith(slash + rest)


def judge(pages: DataFrame, rules: Sequence[tuple[str, bool]] = RULES, url: str = "url", into: str = "judged") -> DataFrame:
    """Add ``into``: host, path, rule, verdict and the classifier's score (millionths of a log-odds); a column of that name is replaced."""
    ready(pages.sparkSession)
    pages = pages.drop(into)
    model = pages.sparkSession.sparkContext.broadcast((weights(), tuple(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rules = model.value
        kind = pa.struct([(c, pa.int64() if c == "score" else pa.string()) for c in ("host", "path", "rule", "verdict", "score")])
        for batch in batches:
            out = []
            for value in batch.column(batch.schema.get_field_index(url)).to_pylist():
                host, path = split(value)
                score = int(w[buckets(host, path)].sum())
                rule = rule_of(host, path, rules)
                block = rule[1] if rule else score > 0
                out.append({"host": host, "path": path, "rule": rule and rule[0], "verdict": "block" if block else "allow", "score": score})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, into])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(into, T.StructType.fromDDL(RESULT))]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *(F.col(f"judged.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "score")))


def oracle() -> str:
    w = weights()
    listed = ", ".join(f"({b}, {int(v)})" for b, v in enumerate(w) if v)
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{'block' if b else 'allow'}')" for r, b in RULES)
    return f"""
WITH weights(bucket, w) AS (VALUES {listed}),
rules(name, start, rule, verdict) AS (VALUES {rules}),
p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
texts AS (SELECT r, 0 AS part, '^' || host || '$' AS t FROM p UNION ALL SELECT r, 1, '^' || path || '$' FROM p),
grams AS (SELECT r, part, substr(t, i, 3) AS g FROM (SELECT r, part, t, unnest(range(1, length(t) - 1)) AS i FROM texts)),
scores AS (
  SELECT r, sum(coalesce(w, 0)) AS score
  FROM (SELECT r, ((unicode(substr(g, 1, 1))::BIGINT * 257 + unicode(substr(g, 2, 1))) * 257 + unicode(substr(g, 3, 1))) % {BUCKETS} + part * {BUCKETS} AS bucket FROM grams) AS b
  LEFT JOIN weights USING (bucket) GROUP BY r),
best AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY r)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN coalesce(score, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(score, 0)::BIGINT AS score
FROM p LEFT JOIN best USING (r) LEFT JOIN scores USING (r)
"""

