"""Similarity producers: perceptual hashes within eight bits, equal fingerprints, place profiles, impossible travel."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.operators.storage import parts, saved
from casegraph.sources.reports import edge


def hash_neighbours(hashes: DataFrame, most: int = vocab.HAMMING_MOST, spare: int | None = None) -> DataFrame:
    """Pairs of different 64-bit hashes at a distance of at most eight bits, with the members of each.

    hashes: hash, sid. Equal hashes fold into one first, so copies make no pairs. A hash is cut into most + spare blocks: two
    near ones agree in spare of them at least, and meet under the first combination that they share. With more spare blocks
    keys are longer and more (9, 45 or 165), so they are chosen by the number of different hashes; pairs are the same.
    """
    one = hashes.groupBy("hash").agg(F.count("*").alias("members"), F.min("sid").alias("first_sid"))
    if spare is None:
        n = one.count()
        spare = 1 if n < 200_000 else 2 if n < 20_000_000 else 3
    blocks = nz.block_masks(most + spare)
    combos = [F.struct(F.lit(k).alias("no"), F.col("hash").bitwiseAND(F.lit(nz.signed(sum(c)))).alias("bits")) for k, c in enumerate(combinations(blocks, spare))]
    cut = one.select("hash", "members", "first_sid", F.explode(F.array(*combos)).alias("k")).select("hash", "members", "first_sid", "k.no", "k.bits")
    side = lambda s: cut.select("no", "bits", F.col("hash").alias(f"hash_{s}"), F.col("members").alias(f"members_{s}"), F.col("first_sid").alias(f"sid_{s}"))
    pairs = side("a").join(side("b"), ["no", "bits"]).filter("hash_a < hash_b").withColumn("distance", nz.hamming(F.col("hash_a"), F.col("hash_b"))).filter(F.col("distance") <= most)
    agree = F.filter(F.array(*[F.when(F.col("hash_a").bitwiseXOR(F.col("hash_b")).bitwiseAND(F.lit(nz.signed(m))) == 0, F.lit(i)) for i, m in enumerate(blocks)]), lambda x: x.isNotNull())
    names = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(len(blocks)), spare)])
    out = pairs.filter(F.slice(agree, 1, spare) == F.get(names, F.col("no")))
    return out.select("hash_a", "hash_b", "distance", F.round(1 - F.col("distance") / 64, 4).alias("similarity"), "members_a", "members_b", "sid_a", "sid_b")


def _met(pairs: DataFrame, same: str) -> DataFrame:
    """Pairs of files of different reports and evidences, the first file by order before the other."""
    return pairs.filter(f"ord_a < ord_b and reportId_a <> reportId_b and evidence_a <> evidence_b{same}")


def _file(files: DataFrame, side: str) -> DataFrame:
    return files.select(*[F.col(c).alias(f"{c}_{side}") for c in ("reportId", "ord", "evidence", "locator", "phash", "hash", "audio")])


def _derived(pairs: DataFrame, relation: str, tail: str, kind: str, confidence, attrs: dict) -> DataFrame:  # noqa: ANN001
    """Edges between the evidences of file pairs."""
    node = lambda s: nz.node_id(F.lit("EVIDENCIA"), F.col(f"evidence_{s}"))
    source = F.concat(F.lit(f"derivacion:{kind}:"), F.least(node("a"), node("b")), F.lit(":"), F.greatest(node("a"), node("b")))
    locator = F.concat("locator_a", F.lit(f"{tail} | "), "locator_b", F.lit(tail))
    return edge(pairs.withColumn("reportId", F.lit(None).cast("string")), ("EVIDENCIA", F.col("evidence_a")), ("EVIDENCIA", F.col("evidence_b")), relation, locator, "analisis_multimedia", confidence=confidence, attrs=attrs, source=source)


def _small(counts: DataFrame, kind: str, product: str) -> DataFrame:
    return counts.withColumn("expanded", F.expr(product) <= vocab.PAIR_CAPS[kind])


def _near_rows(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SIMILITUD_PERCEPTUAL edges of file pairs, and the R11 firings of those that are near but not equal."""
    similarity = 1 - F.col("distance") / 64
    edges = _derived(pairs, "SIMILITUD_PERCEPTUAL", ".details.perceptual_hash", "phash", similarity, {"distance": F.col("distance"), "bits": F.lit(64), "limit": F.lit(vocab.HAMMING_MOST), "similarity": F.round(similarity, 4)})
    of = edges.select("arista_id", "locator", F.col("src_value").alias("evidence_a"), F.col("dst_value").alias("evidence_b"))
    rule = vocab.RULE["R11_PHASH_SIMILAR"]
    told = pairs.filter("distance > 0").withColumn("locator", F.concat("locator_a", F.lit(".details.perceptual_hash | "), "locator_b", F.lit(".details.perceptual_hash"))).join(of, ["evidence_a", "evidence_b", "locator"])
    fired = told.select(F.least("reportId_a", "reportId_b").alias("a"), F.greatest("reportId_a", "reportId_b").alias("b"), F.concat_ws(" ~ ", "phash_a", "phash_b").alias("node_id"), F.lit(rule.name).alias("rule"), near_weight().alias("weight"), F.lit(rule.corroborates).alias("corroborates"), F.split("locator", r" \| ").alias("locators"), F.col("arista_id").alias("support"))
    return edges, fired


def near_weight() -> "Column":  # noqa: F821
    """What a pair of files at a distance gives by R11."""
    return F.round(vocab.RULE["R11_PHASH_SIMILAR"].weight * (1 - F.col("distance") / 64), 4)


def near_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SIMILITUD_PERCEPTUAL edges (equal and near hashes) and R11 firings by file pair, and what stays a class edge.

    A pair of hashes whose files make more pairs than the cap of its kind is one row (hash_a, hash_b, distance, pairs). Its
    links are whole all the same: near_blocks() has them by class of reports, near_among() by pair where pairs are asked for.
    """
    hashed = files.filter("hash is not null")
    sizes = hashed.groupBy("hash").agg(F.count("*").alias("n"))
    near = hash_neighbours(hashed.select("hash", F.col("reportId").alias("sid"))).select("hash_a", "hash_b", "distance", (F.col("members_a") * F.col("members_b")).alias("pairs"))
    equal = sizes.filter("n > 1").select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("pairs"))
    met = saved(_small(near.unionByName(equal), "HASH_PERCEPTUAL", "pairs"))
    few = _turned(met.filter("expanded"))
    pairs = saved(_met(few.join(_file(hashed, "a"), "hash_a").join(_file(hashed, "b"), "hash_b"), ""))
    return *_near_rows(pairs), met.filter("not expanded").select("hash_a", "hash_b", "distance", "pairs")


def _turned(met: DataFrame) -> DataFrame:
    """Hash pairs in both orders, equal hashes once."""
    one = met.select("hash_a", "hash_b", "distance")
    return one.union(one.filter("distance > 0").select("hash_b", "hash_a", "distance"))


def near_among(files: DataFrame, large: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """near_files()'s edges and firings of large hash pairs for the report pairs asked for (a < b) alone."""
    hashed = files.filter("hash is not null")
    pairs = asked.select("a", "b").distinct()
    both = pairs.union(pairs.select("b", "a")).toDF("reportId_a", "reportId_b")
    found = both.join(_file(hashed, "a"), "reportId_a").join(_file(hashed, "b"), "reportId_b").join(_turned(large), ["hash_a", "hash_b"])
    return _near_rows(saved(_met(found, "")))


def near_blocks(files: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What large hash pairs link, without their pairs: blocks (x, y, firings, score; x <= y) and members (class, v).

    Reports whose files have the same hashes (of those in large pairs) and the same evidences (of those that several reports
    have) are one class, named by its least report. All pairs of one report of x and another of y fire R11 alike, as often
    as their files meet, so a block stands for n_x * n_y links (x < y) or n_x * (n_x - 1) / 2 (x = y) of one score.
    """
    turned = saved(_turned(large.filter("distance > 0")))
    hashed = files.filter("hash is not null").join(turned.select(F.col("hash_a").alias("hash")).distinct(), "hash", "left_semi")
    shared = files.groupBy("evidence").agg(F.min("reportId").alias("x"), F.max("reportId").alias("y")).filter("x < y").select("evidence", F.col("evidence").alias("seen"))
    rows = hashed.select("reportId", "hash", "evidence").join(shared, "evidence", "left").groupBy("reportId", "hash", "seen").agg(F.count("*").alias("k"))
    signed = rows.groupBy("reportId").agg(F.array_sort(F.collect_list(F.struct("hash", "seen", "k"))).alias("files"))  # a report's files
    named = saved(signed.withColumn("key", F.sha2(F.to_json("files"), 256)))
    classes = named.groupBy("key").agg(F.min("reportId").alias("class"), F.min_by("files", "reportId").alias("files"), F.count("*").alias("n"))
    classes = saved(classes)
    members = saved(named.select("key", F.col("reportId").alias("v")).join(classes.select("key", "class"), "key").select("class", "v"))
    side = lambda s, h: classes.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.explode("files").alias("f")).select(s, f"n_{s}", F.col("f.hash").alias(h), F.col("f.seen").alias(f"seen_{s}"), F.col("f.k").alias(f"k_{s}"))
    met = turned.join(side("x", "hash_a"), "hash_a").join(side("y", "hash_b"), "hash_b").filter("x <= y and (x < y or n_x > 1)").filter("seen_x is null or seen_y is null or seen_x <> seen_y")
    times = F.col("k_x") * F.col("k_y")
    least = F.product(F.pow(1 - F.least(near_weight(), F.lit(vocab.MOST)), times))
    blocks = met.groupBy("x", "y").agg(F.sum(times).alias("firings"), F.round(F.least(1 - least, F.lit(vocab.MOST)), 4).alias("score"))
    return saved(blocks), members


def equal_audio(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COINCIDE_HUELLA_AUDIO edges by file pair up to the cap, and every class of one fingerprint.

    A class (audio, files, reports, evidences, pairs) stands for all edges between its files of different reports and
    evidences; pairs is their exact number, from counts alone. No rule reads these edges: R12 fires by the fingerprint's node.
    """
    heard = files.filter("audio is not null")
    each = heard.groupBy("audio", "reportId", "evidence").agg(F.count("*").alias("k"))
    two = lambda c: F.expr(f"sum({c} * ({c} - 1) div 2)")
    by = lambda c: each.groupBy("audio", c).agg(F.sum("k").alias("k")).groupBy("audio").agg(two("k").alias(f"same_{c}"), F.sum("k").alias("files"), F.count("*").alias(f"n_{c}"))
    both = each.groupBy("audio").agg(two("k").alias("same_both"))
    counts = by("reportId").join(by("evidence").drop("files"), "audio").join(both, "audio")
    every = F.expr("files * (files - 1) div 2 - same_reportId - same_evidence + same_both")
    classes = saved(_small(counts.filter("files > 1").select("audio", "files", F.col("n_reportId").alias("reports"), F.col("n_evidence").alias("evidences"), every.alias("pairs")), "HUELLA_AUDIO", "files * (files - 1) div 2"))
    few = heard.join(classes.filter("expanded").select("audio"), "audio")
    pairs = _met(_file(few, "a").withColumnRenamed("audio_a", "audio").join(_file(few, "b").withColumnRenamed("audio_b", "audio"), "audio"), "")
    edges = _derived(pairs, "COINCIDE_HUELLA_AUDIO", ".details.audio_fingerprint", "audio", vocab.RULE["R12_HUELLA_AUDIO"].weight, {"fingerprint": F.col("audio")})
    return edges, classes


def place_tags(texts: DataFrame, lexicon: dict[str, tuple[str, tuple[str, ...]]], *keys: str) -> DataFrame:
    """(sid or the keys, tag, dimension) for each lexicon entry whose form stands in the text as whole words."""
    pattern = lambda forms: rf"(?U)(?<!\w)(?:{'|'.join(re.escape(f).replace(chr(92) + ' ', r'\s+') for f in forms)})(?!\w)"
    found = [F.when(F.lower("text").rlike(pattern(forms)), F.struct(F.lit(tag).alias("tag"), F.lit(dim).alias("dimension"))) for tag, (dim, forms) in lexicon.items()]
    keys = keys or ("sid",)
    return texts.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("t")).select(*keys, "t.tag", "t.dimension").distinct()


#: A line of a transcript: time, who speaks, what is said (fixed value).
LINE = r"(?i)^\s*\[[^\]]+\]\s*(Reported\s+User|Other\s+User)\s*\([^)]*\)\s*:\s*(.*)$"


def reported_lines(texts: DataFrame) -> DataFrame:
    """texts with text and locator of what the reported side wrote: its lines of a transcript, any other text whole.

    texts: kind, text, locator and others. Lines that can't be assigned to a speaker are left out.
    """
    chat = F.col("kind") == "transcripcion_chat"
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("no")))
    cut = texts.filter(chat).select("*", F.explode(lines).alias("line")).filter(F.regexp_replace(F.lower(F.regexp_extract("line.x", LINE, 1)), r"\s", "") == "reporteduser")
    cut = cut.withColumn("text", F.regexp_extract("line.x", LINE, 2)).withColumn("locator", F.concat("locator", F.lit("#linea="), "line.no")).drop("line")
    return cut.unionByName(texts.filter(~chat & (F.col("text") != "")))


def place_profiles(texts: DataFrame, lexicon: dict[str, tuple[str, tuple[str, ...]]] = vocab.PLACES) -> DataFrame:
    """sid, tags, dims, locators, hashes of each report that describes a place: two dimensions at least, one an anchor.

    texts: text_id, reportId, kind, locator, text. What the other side of a chat wrote doesn't count.
    """
    said = reported_lines(texts.select("text_id", F.col("reportId").alias("sid"), "kind", "locator", "text"))
    tags = place_tags(said.withColumn("text", nz.strip_marks("text")), lexicon, "sid", "text_id", "locator")
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("tag", "tags"), ("dimension", "dims"), ("locator", "locators"), ("text_id", "hashes"))]
    rows = tags.groupBy("sid").agg(*sets).filter(F.size("dims") >= 2)
    return rows.filter(F.arrays_overlap("dims", F.array(*map(F.lit, vocab.PLACE_ANCHORS))))


def place_edges(profiles: DataFrame) -> DataFrame:
    """MENCIONA_LUGAR of each profile. The texts stay in the restricted store."""
    name = F.concat("sid", F.lit("/"), F.substring(F.sha2(F.concat_ws("|", "sid", F.array_join("tags", "|"), F.array_join("locators", "|")), 256), 1, 16))
    rows = profiles.withColumn("reportId", F.col("sid")).withColumn("place", name)
    facts = {"tags": F.array_join("tags", ","), "dimensions": F.array_join("dims", ","), "hashes": F.array_join("hashes", ","), "restricted": F.lit(True)}
    return edge(rows, ("REPORTE", F.col("sid")), ("LUGAR_MENCION", F.col("place")), "MENCIONA_LUGAR", F.array_join("locators", " | "), "contexto_lugar_controlado", confidence=vocab.PLACE_SURE, attrs={"tags": F.array_join("tags", ",")}, dst_facts=facts, label=F.array_join("tags", ", "))


def _weight(dims) -> "Column":  # noqa: ANN001, F821
    weights = F.create_map(*[F.lit(z) for kv in vocab.PLACE_WEIGHTS.items() for z in kv])
    return F.aggregate(dims, F.lit(0.0), lambda acc, d: acc + F.element_at(weights, d))


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs of tag lists (both_a, both_b: tag and dimension) with score and common tags, if they are similar enough."""
    dims = lambda c: F.array_distinct(F.transform(c, lambda s: s["dimension"]))
    common = F.array_intersect("both_a", "both_b")
    scored = pairs.withColumn("shared", F.transform(common, lambda s: s["tag"])).withColumn("common", dims(common)).withColumn("score", _weight(F.col("common")) / _weight(F.array_union(dims(F.col("both_a")), dims(F.col("both_b")))))
    anchored = F.arrays_overlap("common", F.array(*map(F.lit, vocab.PLACE_ANCHORS)))
    return scored.filter((F.size("common") >= 2) & anchored & (F.col("score") >= vocab.PLACE_LEAST)).withColumn("score", F.round("score", 4))


def place_similarity(tags: DataFrame) -> DataFrame:
    """Profiles (equal tag sets are one class with members) that share two dimensions, one an anchor, and enough weight."""
    profile = tags.groupBy("sid").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.array_sort(F.collect_set(F.struct("tag", "dimension"))).alias("both"))
    one = profile.groupBy("tags").agg(F.count("*").alias("members"), F.min("sid").alias("first_sid"), F.first("both").alias("both"))
    side = lambda s: one.select(F.explode("tags").alias("tag"), F.col("both").alias(f"both_{s}"), F.col("members").alias(f"members_{s}"), F.col("first_sid").alias(f"sid_{s}"))
    meet = side("a").join(side("b"), "tag").filter("sid_a < sid_b").drop("tag").dropDuplicates(["sid_a", "sid_b"])
    return _alike(meet).select("sid_a", "sid_b", "members_a", "members_b", "score")


def place_pairs(profiles: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of reports (a, b, score, shared, locators) and classes of profiles with too many pairs to list.

    Similarity is decided on classes of equal tag sets, of which the lexicon bounds the number. Pairs of small classes are
    listed; of larger ones those among candidates (a, b: pairs that share something else), as place context only corroborates.
    """
    dims = F.create_map(*[F.lit(x) for t, (d, _) in vocab.PLACES.items() for x in (t, d)])
    of = profiles.withColumn("key", F.array_join("tags", "|"))
    one = saved(of.groupBy("key").agg(F.first("tags").alias("tags"), F.count("*").alias("n")).withColumn("both", F.transform("tags", lambda t: F.struct(t.alias("tag"), F.element_at(dims, t).alias("dimension")))))
    side = lambda s: one.select(F.explode("tags").alias("tag"), F.col("both").alias(f"both_{s}"), F.col("key").alias(f"key_{s}"), F.col("n").alias(f"n_{s}"))
    meet = side("a").join(side("b"), "tag").filter("key_a <= key_b").drop("tag").dropDuplicates(["key_a", "key_b"])
    pairs = F.expr("if(key_a = key_b, n_a * (n_a - 1) div 2, n_a * n_b)")
    alike = saved(_alike(meet).withColumn("pairs", pairs).select("key_a", "key_b", "score", "shared", "pairs"))
    member = lambda s: of.select(F.col("key").alias(f"key_{s}"), F.col("sid").alias(f"sid_{s}"), F.col("locators").alias(f"locators_{s}"))
    small = alike.filter(F.col("pairs") <= vocab.DEFAULT_CAP).join(member("a"), "key_a").join(member("b"), "key_b").filter("sid_a <> sid_b and (key_a <> key_b or sid_a < sid_b)")
    large = alike.filter(F.col("pairs") > vocab.DEFAULT_CAP)
    asked = candidates.select(F.col("a").alias("sid_a"), F.col("b").alias("sid_b")).distinct()
    turned = large.union(large.filter("key_a <> key_b").select("key_b", "key_a", "score", "shared", "pairs"))
    among = asked.join(member("a"), "sid_a").join(member("b"), "sid_b").join(turned, ["key_a", "key_b"])
    columns = [F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"), "score", "shared", F.when(F.col("sid_a") < F.col("sid_b"), F.concat("locators_a", "locators_b")).otherwise(F.concat("locators_b", "locators_a")).alias("locators")]
    return small.select(*columns).union(among.select(*columns)), large.select("key_a", "key_b", "score", "pairs")


def place_links(pairs: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SIMILAR_A edges between the place nodes of similar pairs, and R13 firings; mentions: the MENCIONA_LUGAR edges."""
    place = lambda s: mentions.select(F.col("sid").alias(s), F.col("dst_value").alias(f"place_{s}"))
    rows = pairs.join(place("a"), "a").join(place("b"), "b").withColumn("reportId", F.lit(None).cast("string"))
    source, locator = F.concat(F.lit("derivacion:lugar:"), "a", F.lit(":"), "b"), F.array_join("locators", " | ")
    edges = edge(rows, ("LUGAR_MENCION", F.col("place_a")), ("LUGAR_MENCION", F.col("place_b")), "SIMILAR_A", locator, "contexto_lugar_controlado", confidence=F.col("score"), attrs={"tags": F.array_join("shared", ","), "score": F.col("score")}, source=source)
    key = nz.edge_id(nz.node_id(F.lit("LUGAR_MENCION"), F.col("place_a")), nz.node_id(F.lit("LUGAR_MENCION"), F.col("place_b")), F.lit("SIMILAR_A"), F.lit("contexto_lugar_controlado"), locator, source)
    rule = vocab.RULE["R13_CONTEXTO_LUGAR"]
    fired = rows.select("a", "b", F.array_join("shared", ", ").alias("node_id"), F.lit(rule.name).alias("rule"), F.round(rule.weight * F.col("score"), 4).alias("weight"), F.lit(rule.corroborates).alias("corroborates"), "locators", key.alias("support"))
    return edges, fired


def impossible_travel(places: DataFrame) -> DataFrame:
    """Consecutive observations of an anchor too far apart for their time; places: anchor, ip, ts, lat, lon, ord."""
    w = Window.partitionBy("anchor").orderBy("ts", "ord")
    nxt = {c: F.lead(c).over(w).alias(f"n_{c}") for c in ("ip", "ts", "lat", "lon", "ord")}
    ok = "lat between -90 and 90 and lon between -180 and 180"
    o = places.filter(ok).select("*", *nxt.values())
    km = F.round(nz.haversine_km(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")), 3)
    hours = (nz.micros(F.col("n_ts")) - nz.micros(F.col("ts"))) / F.lit(3.6e9)
    out = o.filter("n_ts is not null and ip <> n_ip").withColumn("km", km).withColumn("hours", hours)
    return out.filter((F.col("hours") > 0) & (F.col("km") >= vocab.TRAVEL_KM) & (F.col("km") / F.col("hours") > vocab.TRAVEL_KMH)).select("anchor", F.col("ord").alias("from_ord"), F.col("n_ord").alias("to_ord"), "km", F.round("hours", 4).alias("hours"))


def identity_pairs(mentions: DataFrame, cap: int = vocab.PAIR_CAPS["CUENTA"]) -> DataFrame:
    """Mentions that use one account, as pairs (a < b).

    mentions: mention, account. An account with more pairs than the cap gives the pairs with its least mention alone: the
    same closure, without the square.
    """
    one = mentions.select("mention", "account").distinct()
    sizes = saved(one.groupBy("account").agg(F.count("*").alias("n")).filter("n > 1").withColumn("many", F.expr("n * (n - 1) div 2") > cap))
    large = one.join(sizes.filter("many").select("account"), "account")
    least = large.groupBy("account").agg(F.min("mention").alias("least"))
    star = large.join(least, "account").filter("mention <> least").select(F.col("least").alias("a"), F.col("mention").alias("b"), "account")
    # An account's mentions are one list (its pairs are at most the cap), and its pairs are made where it is.
    rows = sizes.filter("not many").agg(F.sum("n")).first()[0]
    few = one.repartition(parts(one.sparkSession, rows), "account").join(sizes.filter("not many").select("account"), "account")
    all_ = few.groupBy("account").agg(F.array_sort(F.collect_list("mention")).alias("all"))
    first = all_.select("account", F.posexplode("all").alias("at", "a"), "all").select("account", "a", F.slice("all", F.col("at") + 2, F.size("all")).alias("rest"))
    return first.select("a", F.explode("rest").alias("b"), "account").union(star)
