"""Record linkage: inverted index, blocking with pair caps, rule firings, noisy-or scores, links and discards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.operators.storage import parts, saved


def _case(column: Column, values: dict, default) -> Column:  # noqa: ANN001
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def index(incidence: DataFrame) -> DataFrame:
    """(node_id, kind, sid) once, with whether the report has it only from free text, and its locators.

    incidence: sid, kind, value, from_text, locator. The aggregate folds in each task, so a value in a third of all
    reports costs no more than its reports.
    """
    i = incidence.filter("value is not null and sid is not null").withColumn("node_id", nz.node_id(F.col("kind"), F.col("value").cast("string")))
    origin = F.when(F.bool_and("from_text"), "texto_libre").when(F.bool_or("from_text"), "campo_y_texto").otherwise("campo_estructurado")
    return i.groupBy("node_id", "kind", "sid").agg(F.bool_and("from_text").alias("text_only"), origin.alias("origin"), F.collect_set("locator").alias("locators"))


def frequency(idx: DataFrame) -> DataFrame:
    """Reports of each identifier, its possible pairs, its cap, and whether it is expanded or stays a compact group."""
    d = idx.groupBy("node_id", "kind").agg(F.count("*").alias("df"))
    return d.withColumn("possible_pairs", F.expr("df * (df - 1) div 2")).withColumn("cap", _case(F.col("kind"), vocab.PAIR_CAPS, vocab.DEFAULT_CAP).cast("long")).withColumn("expanded", F.col("possible_pairs") <= F.col("cap"))


def groups(freq: DataFrame) -> DataFrame:
    """Identifiers over their cap: they add to no pair and are reported as groups with a policy."""
    policy = F.when(F.col("kind") == "IP", "segmentar_temporalmente").when(F.col("kind").isin("ALIAS", "UBICACION"), "contexto_masivo").otherwise("grupo_compacto")
    return freq.filter(~F.col("expanded")).select("node_id", "kind", "df", "possible_pairs", "cap", policy.alias("policy"))


def _side(own: list[str], s: str) -> list[Column]:
    return [F.col(f"x.{c}").alias({"sid": s, "text_only": f"text_{s}"}.get(c, f"{c}_{s}")) for c in own]


def _own(idx: DataFrame) -> list[str]:
    return ["sid", "text_only", *(["locators"] if "locators" in idx.columns else [])]


def _listed(idx: DataFrame, freq: DataFrame) -> tuple[DataFrame, int, int]:
    """Expanded identifiers of two and more reports with those as a list (all), the number of reports in lists and of pairs."""
    few = freq.filter("expanded and df > 1").select("node_id", "kind", "df", "possible_pairs")
    rows, pairs = few.agg(F.sum("df"), F.sum("possible_pairs")).first()
    each = idx.repartition(parts(idx.sparkSession, rows), "node_id", "kind").join(few, ["node_id", "kind"])
    return each.groupBy("node_id", "kind", "df").agg(F.array_sort(F.collect_list(F.struct(*_own(idx)))).alias("all")), rows, pairs


def _after(met: DataFrame, own: list[str]) -> DataFrame:
    """Each report a of a list, with those after it (rest)."""
    kept = [c for c in met.columns if c != "all"]
    one = met.select(*kept, F.posexplode("all").alias("at", "x"), "all").filter(F.col("at") + 1 < F.size("all"))
    return one.select(*kept, *_side(own, "a"), F.slice("all", F.col("at") + 2, F.size("all")).alias("rest"))


def _paired(here: DataFrame, own: list[str]) -> DataFrame:
    return here.select(*[c for c in here.columns if c != "rest"], F.explode("rest").alias("x")).select("*", *_side(own, "b")).drop("x")


def shared(idx: DataFrame, freq: DataFrame) -> DataFrame:
    """A row for each pair of reports (a < b) and each expanded identifier they share.

    Only identifiers of two reports up to the cap are expanded, so an identifier makes at most its cap of rows. Its reports
    travel as lists: each report a gets those after it, and pairs are made where a is, in parts of as many pairs at any size.
    So what is grouped by pair afterwards needs no further shuffle. idx may leave out locators.
    """
    met, _, pairs = _listed(idx, freq)
    return _paired(_after(met, _own(idx)).repartition(parts(idx.sparkSession, pairs), "a"), _own(idx))


def compact(idx: DataFrame, freq: DataFrame, reports: int, least: float = vocab.CLUSTER) -> tuple[DataFrame, DataFrame]:
    """The links of at least that score without a row for each: groups (at, weight) and scored pairs.

    Where an identifier alone links any two of its reports they are a group at its weight. Pairs that share more than one
    identifier, or one that some report has from text only, are scored by themselves: their score stands for them instead.
    Of the rest none scores so much. No address and extra rules.
    """
    met, rows, _ = _listed(idx.select("node_id", "kind", "sid", "text_only"), freq)
    met = saved(met.withColumn("texts", F.exists("all", lambda x: x["text_only"])))
    plain = met.filter("not texts").select("node_id", "kind", "df", F.transform("all", lambda x: x["sid"]).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("text_a"), F.lit(False).alias("text_b"))
    whole = saved(firings(plain, reports).filter(~F.col("corroborates") & (F.col("weight") >= max(least, vocab.PROPOSE))).select(F.col("a").alias("at"), "weight"))
    own = ["sid", "text_only"]
    here = _after(met, own).repartition(parts(idx.sparkSession, rows), "a").groupBy("a").agg(F.collect_list(F.struct("node_id", "kind", "df", "texts", "text_a", "rest")).alias("all"))
    others = F.flatten(F.transform("all", lambda x: F.transform(x["rest"], lambda y: y["sid"])))
    some = here.filter(F.exists("all", lambda x: x["texts"]) | (F.size(others) > F.size(F.array_distinct(others)))).select("a", F.explode("all").alias("k")).select("a", "k.*")
    pair = Window.partitionBy("a", "b")
    pairs = _paired(some, own).withColumns({"n": F.count("*").over(pair), "texts": F.max("texts").over(pair)}).filter("n > 1 or texts")
    return whole, score(firings(pairs, reports))


def _locators(pairs: DataFrame) -> Column:
    both = F.concat("locators_a", "locators_b") if "locators_a" in pairs.columns else F.array().cast("array<string>")
    return both.alias("locators")


def firings(pairs: DataFrame, reports: int) -> DataFrame:
    """Same-node rules with their effective weights: discriminance, and a factor for each side known from text only.

    Addresses need times and NAT context: ip_firings().
    """
    simple = [r for r in vocab.RULES if r.kind not in ("IP", "LUGAR_MENCION")]
    kind = F.col("kind")
    name, weight = _case(kind, {r.kind: r.name for r in simple}, None), _case(kind, {r.kind: r.weight for r in simple}, None)
    corr, disc = _case(kind, {r.kind: r.corroborates for r in simple}, True), _case(kind, {r.kind: r.discriminates for r in simple}, False)
    sides = F.col("text_a").cast("int") + F.col("text_b").cast("int")
    strength = weight * F.when(disc, nz.discriminance(F.col("df"))).otherwise(1.0) * F.pow(F.lit(vocab.TEXT_FACTOR), sides)
    common = (name != "R01_CUENTA") & nz.is_common(F.col("df"), F.lit(reports))
    out = pairs.withColumn("rule", name).filter(F.col("rule").isNotNull())
    return out.select("a", "b", "node_id", "rule", F.round(strength, 4).alias("weight"), (corr | common).alias("corroborates"), _locators(pairs))


def spanning(idx: DataFrame, freq: DataFrame, reports: int, least: float = vocab.CLUSTER) -> DataFrame:
    """(a, b): links with the same components as all pairs that score at least so much, without address and extra rules.

    Where an identifier alone links any two of its reports, its first report with each other one will do. The other
    identifiers are expanded and scored without those: a pair that shares one of them is connected already.
    """
    few = freq.filter("expanded and df > 1")
    plain = few.select("node_id", "kind", "df", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("text_a"), F.lit(False).alias("text_b"))
    alone = firings(plain, reports).filter(~F.col("corroborates") & (F.col("weight") >= max(least, vocab.PROPOSE))).select("node_id")
    sure = saved(alone.join(idx.filter("text_only").select("node_id").distinct(), "node_id", "left_anti"))
    rows = few.agg(F.sum("df")).first()[0]
    mine = idx.repartition(parts(idx.sparkSession, rows), "node_id").join(sure, "node_id", "left_semi").select("node_id", "sid")
    first = mine.groupBy("node_id").agg(F.min("sid").alias("a"))
    stars = mine.join(first, "node_id").filter("sid <> a").select("a", F.col("sid").alias("b"))
    rest = saved(few.join(sure, "node_id", "left_anti"))
    return stars.union(links(score(firings(shared(idx, rest), reports))).filter(F.col("score") >= least).select("a", "b"))


def uncapped(idx: DataFrame, freq: DataFrame, reports: int, least: float = vocab.CLUSTER) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links of at least that score as if no identifier had a cap: spanning links, scored pairs, and blocks with their members.

    Over its cap an identifier that alone links any two of its reports isn't expanded: reports with the same ones of those are a
    class, classes that share one are a block (as in graph.Implied; its score is the weight of that identifier). One that only
    corroborates links nothing by itself, so it is looked up for the pairs that others sustain and don't lift to that score;
    scores of pairs that reach it anyway leave it out. What is left, sustaining with reports from text only, is expanded.
    """
    n, over = ["node_id", "kind"], freq.filter("not expanded and df > 1")
    plain = over.select(*n, "df", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("text_a"), F.lit(False).alias("text_b"))
    able = firings(plain, reports).filter(~F.col("corroborates")).select("node_id", "weight")
    texts = idx.filter("text_only").select("node_id").distinct()
    sure = saved(able.filter(F.col("weight") >= max(least, vocab.PROPOSE)).join(texts, "node_id", "left_anti"))
    rest = saved(able.select("node_id").join(sure, "node_id", "left_anti").withColumn("rest", F.lit(True)))
    freq = freq.join(rest, "node_id", "left").withColumn("expanded", F.col("expanded") | F.coalesce("rest", F.lit(False))).drop("rest")
    scored = saved(score(firings(shared(idx, freq), reports)).filter("sustained").select("a", "b", "rules", "firings", "score", "band", "linked", F.when(F.col("score") < least, F.col("details")).alias("details")))
    low = scored.filter(F.col("score") < least)
    wide = idx.join(over.join(able, "node_id", "left_anti").select(*n, "df"), n).select(*n, "df", "sid", "text_only")
    end = lambda s: wide.select("node_id", F.col("sid").alias(s), F.col("text_only").alias(f"text_{s}"), *(("kind", "df") if s == "a" else ()))
    more = low.select("a", "b").join(end("a"), "a").join(end("b"), ["node_id", "b"])
    known = low.select("a", "b", F.explode("details").alias("d")).select("a", "b", "d.node_id", "d.rule", "d.weight", "d.corroborates")
    lifted = saved(links(score(known.unionByName(firings(more, reports).drop("locators")).withColumn("locators", F.array().cast("array<string>")))).filter(F.col("score") >= least))
    pairs = links(scored.filter(F.col("score") >= least)).union(lifted)
    mine = saved(idx.join(sure, "node_id").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("node_id", "weight"))).alias("ids")).withColumn("class", F.sha2(F.to_json("ids"), 256)))
    classes = mine.select("class", "ids").distinct().select("class", F.explode("ids").alias("id")).select("class", "id.*")
    x, y = classes.withColumnRenamed("class", "x"), classes.select(F.col("class").alias("y"), "node_id")
    blocks = x.join(y, "node_id").filter("x <= y").groupBy("x", "y").agg(F.max("weight").alias("score"))
    first = idx.join(sure, "node_id", "left_semi").groupBy("node_id").agg(F.min("sid").alias("a"))
    stars = idx.join(first, "node_id").filter("sid <> a").select("a", F.col("sid").alias("b"))
    return spanning(idx, freq, reports, least).union(stars).union(lifted.select("a", "b")), pairs, blocks, mine.select("class", F.col("sid").alias("v"))


def nearest_captures(pairs: DataFrame, captures: DataFrame) -> DataFrame:
    """pairs (node_id, a, b, ...) with micros between the nearest two captures, whether both have ports and either hides its user.

    captures: node_id, sid, ts, port, nat, locator. All three are null where a report has no time. Of equally near ones the least
    locators count. Captures of one report at one time fold to that of the least locator first; then a pair's times are one sorted
    list, in which the nearest two of different sides are neighbours. So a pair costs as many rows as its two reports have, never
    their product. The joins merge: Spark takes lists of captures for smaller than they are and would send them to the driver.
    """
    one = F.min(F.struct("locator", nz.given(F.col("port")).alias("port"), "nat")).alias("c")
    seen = captures.filter("ts is not null").groupBy("node_id", "sid", nz.micros(F.col("ts")).alias("t")).agg(one)
    times = seen.groupBy("node_id", "sid").agg(F.collect_list(F.struct("t", "c")).alias("times"))  # of one report and address
    side = lambda s: times.select("node_id", F.col("sid").alias(s), F.col("times").alias(f"times_{s}")).hint("merge")
    tag = lambda c, k: F.transform(c, lambda x: F.struct(x["t"].alias("t"), F.lit(k).alias("side"), x["c"].alias("c")))

    def step(x: Column, y: Column) -> Column:
        first = F.when(x["side"] == 0, x["c"]).otherwise(y["c"])
        second = F.when(x["side"] == 0, y["c"]).otherwise(x["c"])
        return F.when(x["side"] != y["side"], F.struct((y["t"] - x["t"]).alias("micros"), first["locator"].alias("at_a"), second["locator"].alias("at_b"), (x["c"]["port"] & y["c"]["port"]).alias("ports"), (x["c"]["nat"] | y["c"]["nat"]).alias("nat")))

    met = pairs.join(side("a"), ["node_id", "a"], "left").join(side("b"), ["node_id", "b"], "left")
    met = met.withColumn("m", F.array_sort(F.concat(tag("times_a", 0), tag("times_b", 1)))).drop("times_a", "times_b")
    n = F.size("m") - 1
    least = F.array_min(F.array_compact(F.zip_with(F.slice("m", F.lit(1), n), F.slice("m", F.lit(2), n), step)))
    return met.withColumn("m", F.when(F.col("m").isNotNull(), least)).select(*pairs.columns, "m.micros", "m.ports", "m.nat")


def ip_firings(pairs: DataFrame, captures: DataFrame, windows: DataFrame, reports: int) -> DataFrame:
    """R06 or R07 for each pair and shared address, with their effective weights, like firings().

    captures: node_id, sid, ts, port, nat (the address or the capture hides its user), locator; windows: node_id, hours. The
    nearest two captures decide. Inside the window R06 fires, under NAT weaker, and without both ports it only corroborates;
    outside it or without a time on either side R07 fires.
    """
    best = nearest_captures(pairs.filter("kind = 'IP'"), captures).withColumn("hours", F.col("micros") / F.lit(3.6e9))
    x = best.join(windows.select("node_id", F.col("hours").alias("window")), "node_id", "left")
    near = F.coalesce(F.col("hours") <= F.coalesce("window", F.lit(vocab.DEFAULT_HOURS)), F.lit(False))
    hidden = near & F.col("nat")
    r06, r07 = vocab.RULE["R06_IP_VENTANA"], vocab.RULE["R07_IP_SUELTA"]
    context = F.when(hidden & F.col("ports"), vocab.NAT_WITH_PORT).when(hidden, vocab.NAT_WITHOUT_PORT).otherwise(1.0)
    sides = F.col("text_a").cast("int") + F.col("text_b").cast("int")
    strength = F.when(near, r06.weight).otherwise(r07.weight) * context * nz.discriminance(F.col("df")) * F.pow(F.lit(vocab.TEXT_FACTOR), sides)
    weak = ~near | (hidden & ~F.col("ports")) | nz.is_common(F.col("df"), F.lit(reports))
    return x.select("a", "b", "node_id", F.when(near, r06.name).otherwise(r07.name).alias("rule"), F.round(strength, 4).alias("weight"), weak.alias("corroborates"), _locators(pairs))


def noisy_or(weight: str, corroborates: str) -> tuple[Column, Column]:
    """Score and whether it is sustained: one minus the product of complements, at most 0.99; zero if all only corroborate."""
    sustained = F.bool_or(~F.col(corroborates))
    score = F.round(F.least(1 - F.product(1 - F.least(F.col(weight), F.lit(vocab.MOST))), F.lit(vocab.MOST)), 4)
    return F.when(sustained, score).otherwise(0.0), sustained


def present(fired: DataFrame, reports: DataFrame) -> DataFrame:
    """Firings whose two reports exist; reports: sid."""
    return fired.join(reports.select(F.col("sid").alias("a")), "a", "left_semi").join(reports.select(F.col("sid").alias("b")), "b", "left_semi")


def alive(fired: DataFrame, edges: DataFrame) -> DataFrame:
    """Extra firings whose supporting edge is there and current."""
    return fired.join(edges.filter("current").select(F.col("arista_id").alias("support")), "support", "left_semi").drop("support")


def score(fired: DataFrame) -> DataFrame:
    """A row for each pair: rules, their details, score, sustained, class (band), and whether it becomes a link.

    Details stand by sustaining ones first, then weight. Columns that a query doesn't read aren't computed.
    """
    points, sustained = noisy_or("weight", "corroborates")
    # Names of rules are bits of a number, so that without details or locators a pair's state has a fixed size.
    names = sorted(vocab.RULE)
    bit = _case(F.col("rule"), {r: 1 << k for k, r in enumerate(names)}, None)
    bit = F.coalesce(bit, F.raise_error(F.concat(F.lit("unknown rule "), F.coalesce("rule", F.lit("null")))).cast("int"))
    rules = F.concat_ws(",", *[F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, r) for k, r in enumerate(names)])
    locators = F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("locators")))), F.lit(1), F.lit(12)), " | ")
    detail = F.array_sort(F.collect_list(F.struct(F.col("corroborates").alias("corroborates"), (-F.col("weight")).alias("order"), "rule", "node_id", "weight")))
    out = fired.groupBy("a", "b").agg(F.bit_or(bit).alias("rules"), F.count("*").alias("firings"), points.alias("score"), sustained.alias("sustained"), locators.alias("locator"), F.transform(detail, lambda d: d.dropFields("order")).alias("details"))
    return out.withColumn("rules", rules).withColumn("band", nz.band(F.col("score"))).withColumn("linked", F.col("sustained") & (F.col("score") >= vocab.PROPOSE))


def links(scored: DataFrame) -> DataFrame:
    return scored.filter("linked").select("a", "b", "rules", "firings", "score", "band")


def discarded(scored: DataFrame) -> DataFrame:
    reason = F.when(~F.col("sustained"), "no_sostenido").otherwise("bajo_umbral")
    return scored.filter("not linked").select("a", "b", "rules", "score", reason.alias("reason"))


def duplicates(linked: DataFrame, reports: DataFrame, hours: float = 1.0) -> DataFrame:
    """Links through an account whose reports share the platform and lie at most an hour apart; reports: sid, platform, ts."""
    x, y = (reports.select(F.col("sid").alias(s), F.col("platform").alias(f"p_{s}"), F.col("ts").alias(f"t_{s}")) for s in "ab")
    near = F.col("rules").contains("R01_CUENTA") & (F.col("p_a") == F.col("p_b")) & (nz.hours_between(F.col("t_a"), F.col("t_b")) <= hours)
    return linked.join(x, "a").join(y, "b").filter(near).select("a", "b", "score", F.lit("POSIBLE_DUPLICADO_DE").alias("relation"))


def window_match(observations: DataFrame, windows: DataFrame) -> DataFrame:
    """Same address in two reports: the nearest pair of times decides between R06 (in the provider's window) and R07.

    observations: ip, sid, ts; windows: ip, hours. The window is tested on exact times; hours are rounded for people.
    """
    seen = observations.select(F.col("ip").alias("node_id"), F.lit("IP").alias("kind"), "sid", "ts", F.lit(None).cast("string").alias("port"), F.lit(False).alias("nat"), F.lit("").alias("locator"))
    idx = seen.groupBy("node_id", "kind", "sid").agg(F.lit(False).alias("text_only"), F.array().cast("array<string>").alias("locators"))
    best = nearest_captures(shared(idx, frequency(idx)), seen).filter("micros is not null").withColumnRenamed("node_id", "ip").withColumn("exact", F.col("micros") / F.lit(3.6e9))
    fit = best.join(windows.select("ip", F.col("hours").alias("window")), "ip", "left").withColumn("window", F.coalesce("window", F.lit(vocab.DEFAULT_HOURS)))
    return fit.select("ip", "a", "b", F.round("exact", 4).alias("hours"), "window", F.when(F.col("exact") <= F.col("window"), "R06_IP_VENTANA").otherwise("R07_IP_SUELTA").alias("rule"))


def same_evidence(incidence: DataFrame) -> DataFrame:
    """Values found in several sources: value, members, first member (no pairs are expanded)."""
    return incidence.groupBy("value").agg(F.count("*").alias("members"), F.count_distinct("source").alias("sources"), F.min("sid").alias("first_sid")).filter("members > 1")


def first_writer(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Node upsert: the first non-null value by order, and the other values as variants."""
    agg = rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias("value"), F.array_sort(F.collect_set(value)).alias("__all"))
    return agg.select(key, "value", F.array_join(F.array_except("__all", F.array("value")), ",").alias("variants"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key by order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")
