"""Quality rules by document and by host.

DataFrame functions only. Each text is read once, in its own row: repeated windows are
found by sorting the hashes of a document's windows, so no words are shuffled. What a
document breaks of ``RULES`` is summed by host, and each host's rate of each rule is
shrunk by a beta prior fitted to the rates of all hosts. From the posterior, a host is

- rejected, if one of its rates is credibly over a limit: all its documents go;
- trusted in a rule, if its rate is credibly below the prior's mean: it gets the benefit
  of the doubt. Documents that break the rule go on every other host.

A document that breaks no rule goes only with a rejected host. Very long texts are read
whole, as any other: a document's words are an array in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacewing.llm.common import SPACES, let, words
from lacewing.session import written

#: Words in a window whose repetition counts.
WINDOW = 5
#: Hosts with a verdict of their own that are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Rules that hosts are judged by. The first settles a document by itself; the others, whose
#: bounds are the customary ones for web text, go by the verdict on its host.
RULES = {
    "base_failed": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "many_repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_words": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
SOFT = [r for r in RULES if r != "base_failed"]


def _repeated_words(w: Column) -> Column:
    """How many words lie in a window of the text that occurs in it twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            at = lambda j: F.get(p, j)["h"]
            again = F.filter(p, lambda x, j: x["h"].eqNullSafe(at(j - 1)) | x["h"].eqNullSafe(at(j + 1)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        # each window adds the words up to the next one's start, WINDOW at most
        reach = lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
        return let(let(pairs, twice), reach)

    def count(h: Column) -> Column:
        shifted = F.arrays_zip(*[F.slice(h, k + 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))).alias(f"w{k}") for k in range(WINDOW)])
        windows = F.transform(shifted, lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(WINDOW)]))
        return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), count))


def document_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The base figures of each row and which of ``RULES`` it breaks, beside ``keep`` (``doc_id`` if not given)."""
    keep = keep or ["doc_id"]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    base = docs.select(*keep, words(F.col("text")).alias("__w"), lines.alias("__lines"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    long = lambda c: c.cast("long")
    figures = base.select(
        *keep, long(F.size("__w")).alias("n_words"), long(F.length(F.array_join("__w", ""))).alias("word_chars"), "n_symbols", long(F.size("__lines")).alias("n_lines"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), long(_repeated_words(F.col("__w"))).alias("n_repeat_words"),
    )
    return figures.withColumns({name: F.expr(rule) for name, rule in RULES.items()})


def host_verdicts(documents: DataFrame, limit: float = 0.5, host: str = "source", z: float = 1.0) -> DataFrame:
    """``(host, n, rejected)`` and, for each rule, ``rate_<rule>`` and ``trusted_<rule>``: a row per host.

    ``documents`` has the host and a boolean column for each of ``RULES``. A rule's prior is
    fitted to the hosts' rates by the method of moments over all hosts, weighted equally;
    where their variance says nothing it counts as one document. ``rate`` is the posterior
    mean. A host is rejected if a rate less ``z`` posterior deviations is over ``limit``, and
    trusted in a rule if its rate plus ``z`` deviations is below the prior's mean.
    """
    hosts = documents.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(f"failed_{r}") for r in RULES])
    hosts = written(hosts, "hosts")
    moments = hosts.agg(*[f(F.col(f"failed_{r}") / F.col("n")) for r in RULES for f in (F.avg, F.var_samp)]).first()
    out, rejected = {}, F.lit(False)
    for k, r in enumerate(RULES):
        m, v = moments[2 * k] or 0.0, moments[2 * k + 1] or 0.0
        s = max(m * (1 - m) / v - 1, 1.0) if v > 0 else 1.0
        rate = (F.col(f"failed_{r}") + F.lit(m * s)) / (F.col("n") + F.lit(s))
        spread = F.lit(z) * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(s) + 1))
        rejected = rejected | (rate - spread > limit)
        out |= {f"rate_{r}": rate, f"trusted_{r}": rate + spread < m}
    return hosts.withColumns(out | {"rejected": rejected}).select(host, "n", "rejected", *out)


def _judged(documents: DataFrame, limit: float, host: str, z: float, broadcast_hosts: int) -> tuple[DataFrame, Column]:
    """``documents`` with the verdicts on their hosts beside them, and which rows stay by those."""
    own = {r: f"__trusted_{r}" for r in SOFT}
    verdicts = host_verdicts(documents, limit, host, z)
    verdicts = verdicts.select(F.col(host).alias("__judged"), F.col("rejected").alias("__rejected"), *[F.col(f"trusted_{r}").alias(c) for r, c in own.items()])
    # ordinary hosts need no row
    verdicts = written(verdicts.filter(" OR ".join(["__rejected", *own.values()])), "verdicts")
    if verdicts.count() <= broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    rows = documents.join(verdicts, F.col(host).eqNullSafe(F.col("__judged")), "left")
    stays = ~F.coalesce("__rejected", F.lit(False))
    for r, c in own.items():
        stays = stays & (~F.col(r) | F.coalesce(c, F.lit(False)))
    return rows, stays


def quality_rules(docs: DataFrame, limit: float = 0.5, host: str = "source", z: float = 1.0, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, <a column per rule>, kept)``.

    ``docs`` has ``doc_id, text`` and the host column; other columns are ignored. Null
    text has no words and fails. Rows without a host are a host of their own. Repeated
    rows are judged and counted each; an empty table gives no rows. ``kept`` is false for
    a document that fails by itself, on a rejected host, or that breaks a rule its host isn't
    trusted in.
    """
    figures = written(document_rules(docs, ["doc_id", host]), "figures")
    rows, stays = _judged(figures, limit, host, z, broadcast_hosts)
    return rows.select(*figures.columns, (~F.col("base_failed") & stays).alias("kept"))


def keep_good_documents(docs: DataFrame, limit: float = 0.5, host: str = "source", z: float = 1.0, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Each row goes by its own verdict, whatever its ``doc_id``. The rows that pass by
    themselves are written once; the hosts' verdicts then need no second look at texts.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text", F.col(host).alias("__host"))
    judged = document_rules(rows, ["__row", "__host"])
    passed = F.when(~F.col("base_failed"), F.col("__row")).alias("__row")
    judged = written(judged.select(passed, "__host", *RULES), "judged")
    rows, stays = _judged(judged, limit, "__host", z, broadcast_hosts)
    return rows.filter(~F.col("base_failed") & stays).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
