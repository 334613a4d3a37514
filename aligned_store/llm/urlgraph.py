"""URL filters by link-graph propagation, with DataFrame functions alone.

Rules (host, path) judge the pages they fit. Hosts of allowed pages are trusted seeds, those of blocked
pages blocked seeds, each by how many such pages it has. Personalised PageRank spreads trust along the
links between hosts, and distrust against them: who links to blocked hosts is suspect. What comes to hosts
without further links goes back to the seeds. Pages without a rule are blocked where their host's distrust is
``threshold`` times its trust or more, and allowed elsewhere, also where nothing is known.

Links are those of ``a`` and ``area`` elements, relative ones resolved against ``base``; links within a host are
no edges. With ``family``, which is off, hosts are also joined to their parent domains and back.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed.
Null html has no links. Repeated rows are judged each and add to the weights of links. A missing seed
side has no mass. Where trust and distrust tie (to ``TIE`` places) a page is blocked; of rules of one length
that fit, the first by verdict and name counts. Ids may be of any type; extra columns are ignored. An empty table
gives no rows. Pages of any length are read whole, by the engine's own functions.

Rounds go on until both ranks are within ``TOLERANCE`` of their limits (sum of absolute differences),
nothing has reached a further host, and no host's difference of distrust and ``threshold`` times trust is so
small that what is left to move could change its sign; ties go on until the ranks are within ``EXACT``.
``damping`` to the power of k rounds bounds what they leave, so at 0.85 that is about 90 rounds where
differences are plain, about 200 with ties, and more only where links lead further from the seeds.

Mass that goes back to the seeds only adds a multiple of what the seeds send out anyway, as they are where all
of it begins. So ranks are iterated without it, and scaled to a sum of one at the end.

Scale: links are counted by host pair before the first shuffle; the ranks of both kinds go in one frame,
and each round is one join and one aggregation; every ``STRIDE`` rounds are written to the shared folder. A hub
is one row of each rank, and many rows of edges: those are spread by a hash of their ends before they meet it.
Pages take their host's rank in a join that no common host holds up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, forget, lookup


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
DAMPING, THRESHOLD = 0.85, 1.0
TOLERANCE, EXACT, STRIDE, TIE = 1e-6, 1e-14, 8, 12
HUB_PARTS = 64
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""\shref\s*=\s*["']?\s*([^"'\s<>]+)"""
_LINK = rf"(?is)<(?:a|area)(?:\s[^>]*)?{_HREF}"
_BASE = rf"(?is)<base(?:\s[^>]*)?{_HREF}"
#: The host of an absolute reference; what other references are relative to the base.
_ABSOLUTE, _SCHEME = "(?is)^(?:https?:)?//([^/?#]*)", "(?is)^[a-z][a-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _pick(rules, of) -> Column:
    """``of`` the longest rule that fits (of equal ones the first by verdict and name), else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict, r.name)):
        host, path = F.col("host"), F.col("path")
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, of(r)) if out is None else out.when(fits, of(r))
    return F.lit(None).cast("string") if out is None else out


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", family: bool = False, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; ``rounds`` as of :func:`propagate`."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = base.select("page_id", "host", "path", _pick(rules, lambda r: F.lit(r.name)).alias("rule"), _pick(rules, lambda r: F.lit(r.verdict)).alias("ruled"))
    seeds = cut(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "seeds")
    ranks = propagate(links_of(pages, url_col, html_col), seeds, family, damping, rounds, threshold)
    suspect = (F.col("distrust") > 0) & (F.round("distrust", TIE) >= F.round(threshold * F.col("trust"), TIE))
    verdict = F.coalesce("ruled", F.when(suspect, "block").otherwise("allow"))
    return lookup(judged, cut(ranks, "ranks"), ["host"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, w): how many links lead from pages of a host to another."""
    html = F.col(f"`{html_col}`")
    host = lambda ref: ascii_lower(F.regexp_extract(ref, _ABSOLUTE, 1))
    own = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), html.alias("html"))
    based = own.where("src <> ''").select("src", host(F.regexp_extract("html", _BASE, 1)).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("ref"))
    to = F.when(F.col("ref").rlike(_ABSOLUTE), host(F.col("ref"))).when(~F.col("ref").rlike(_SCHEME), F.col("base"))
    return based.select("src", to.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def _family(hosts: DataFrame) -> DataFrame:
    """Edges between each host and its parent, up to two labels; parents are nodes of their own."""
    labels = F.split("host", r"\.")
    up = F.explode(F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("dst")))))
    one = hosts.select(up.alias("e")).select("e.src", "e.dst").distinct()
    return one.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("w"))


def _settled(old: DataFrame, new: DataFrame, left: float, threshold: float) -> bool:
    """Whether further rounds change no verdict and no rank by much; the limit is within ``left`` times the change since ``old``."""
    of = lambda kind, col: F.sum(F.when(F.col("kind") == kind, F.col(col)).otherwise(0.0))
    both = new.select("kind", "host", "rank", F.lit(0.0).alias("was")).unionByName(old.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
    hosts = cut(both.groupBy("host").agg(*[of(k, c).alias(k + c) for k in "td" for c in ("rank", "was")]), "settled")
    further = F.count_if(((F.col("trank") > 0) & (F.col("twas") == 0)) | ((F.col("drank") > 0) & (F.col("dwas") == 0)))
    seen = hosts.agg(*[F.sum(F.abs(F.col(k + "rank") - F.col(k + "was"))).alias(k) for k in "td"], *[F.sum(k + "rank").alias("all" + k) for k in "td"], further.alias("further")).first()
    if seen.t is None:
        return True
    # scaled ranks are off by the change left and by what it makes in their sum
    all_t, all_d = seen.allt or 1.0, seen.alld or 1.0
    t, d = 2 * seen.t * left / all_t, 2 * seen.d * left / all_d
    gap = hosts.agg(F.min(F.abs(F.col("drank") / all_d - threshold * F.col("trank") / all_t)).alias("gap")).first().gap
    forget(hosts)
    return not seen.further and (max(t, d) <= EXACT or max(t, d) <= TOLERANCE and gap > d + threshold * t)


def propagate(links: DataFrame, seeds: DataFrame, family: bool = False, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """links (src, dst, w), seeds (host, good, bad) -> (host, trust, distrust), each summing to 1, or to 0 without seeds.

    Without ``rounds`` the ranks are those at convergence; with it, those after so many rounds.
    """
    if rounds is None and not 0 <= damping < 1:
        raise ValueError("ranks converge only at a damping of 0 or more and less than 1")
    edges = links.unionByName(_family(seeds.select("host"))) if family else links
    edges = cut(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "links")
    both = edges.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), "src", "dst", "w"), F.struct(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))).alias("e")).select("e.*")
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    # a hub's edges are in several parts, each with its own copy of what the hub sends out
    part = F.pmod(F.xxhash64("dst"), F.lit(HUB_PARTS)).cast("int").alias("part")
    shares = lookup(both, cut(out, "sums"), ["kind", "src"], "inner")
    steps = cut(shares.select(F.col("kind").alias("of"), "src", part, "dst", (F.col("w") / F.col("all")).alias("share")), "edges")
    parts = cut(steps.select("of", "src", "part").distinct(), "parts")
    mass = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    sides = [F.struct(F.lit(k).alias("kind"), (F.col(c) / float(m)).alias("rank")) for k, c, m in (("t", "good", mass.g), ("d", "bad", mass.b)) if m]
    if not sides:
        return seeds.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    start = cut(seeds.select("host", F.explode(F.array(*sides)).alias("s")).select("s.kind", "host", "s.rank").where("rank > 0"), "start")
    rank, done = start, 0
    if steps.isEmpty():  # nothing moves, so the scaled ranks are the seeds' shares
        rounds = 0
    while rounds is None or done < rounds:
        new, some = rank, STRIDE if rounds is None else min(STRIDE, rounds - done)
        for _ in range(some):
            sent = new.join(parts, (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src"))).select("of", "src", "part", "rank")
            moved = sent.join(steps, ["of", "src", "part"]).select(F.col("of").alias("kind"), F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            new = moved.unionByName(start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        new, done = cut(new, "rank"), done + some
        # each round shrinks what is left to move by damping at least
        settled = rounds is None and _settled(rank, new, damping**some / (1 - damping**some), threshold)
        if rank is not start:
            forget(rank)
        rank = new
        if settled:
            break
    totals = {r.kind: r.all for r in rank.groupBy("kind").agg(F.sum("rank").alias("all")).collect()}
    of = lambda k: (F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)) / F.lit(float(totals.get(k) or 1.0)))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))
