"""LAY-14 in full: header lines of pages by profiles of banks, as data: what a header line must hold and must not, what its words and
phrases count, how far above and below its words may stand, what names a column, and where columns part.

A profile is a row of a small fixed table; all profiles become one literal, so a page is read without a join. One shuffle brings a
page's words together; only the words near the elected line are gathered, never a whole page.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for no limit at the left and right end.
FAR = 10_000.0


@dataclass
class Look:
    """A pattern for one word, or for two words side by side; ``shift`` moves the left edge found."""

    pattern: str
    words: int = 1
    shift: float = 0.0


@dataclass
class Absent:
    """Where a column is thought to be that no word names: from the right edge of another."""

    of: str
    left: float
    right: float


@dataclass
class Named:
    """A column, the looks for it in order, and its place: edges of the word found, with pads. ``spread``: from the first match's left
    edge to the last one's right edge, else the first match. ``near``: words of the lines around count too."""

    name: str
    looks: list[Look]
    left_of: str = "x0"
    left: float = 0.0
    right_of: str = "x1"
    right: float = 0.0
    spread: bool = False
    near: bool = False
    absent: list[Absent] = field(default_factory=list)


@dataclass
class Part:
    """Where two neighbours part: the end of the one before and the start of the one after, each by ``mid`` (between right and left
    edge), ``edges`` (between the right edges), ``before`` (from the right edge of the one before) or ``after`` (from the left edge of
    the one after), with an offset. ``*`` is any column; the first that fits counts, else ``mid`` for both."""

    before: list[str]
    after: list[str]
    end: str
    end_by: float
    start: str
    start_by: float


@dataclass
class Profile:
    """``count``: ``pairs`` (each keyword in each word), ``words`` (words with any), ``whole`` (words that are one), ``distinct``
    (keywords on the lines within ``reach``) or ``first`` (the topmost line that fits). ``below``: words that make the next line
    part of the header. ``first``/``last``: ``zero``/``thousand``, ``open``, or ``own`` (its own edge, moved by ``first_by``)."""

    keywords: list[str]
    fields: list[Named]
    required: list[list[str]]
    needed: list[list[str]] = field(default_factory=list)
    banned: list[str] = field(default_factory=list)
    bonus: list[tuple[list[str], int]] = field(default_factory=list)
    count: str = "pairs"
    least: int = 3
    reach: float = 0.0
    below: list[str] = field(default_factory=list)
    latest: bool = False
    parts: list[Part] = field(default_factory=list)
    first: str = "zero"
    first_by: float = 0.0
    last: str = "thousand"
    printed_order: bool = False


def _one(*patterns: str) -> list[Look]:
    return [Look(p) for p in patterns]


def _both(before: list[str], after: list[str], how: str, by: float) -> Part:
    return Part(before, after, how, by, how, by)


_MONEY = ["DEBIT", "CREDIT", "WITHDRAWAL", "DEPOSIT"]
_MOVES, _SUMS = ["debit", "credit"], ["debit", "credit", "balance"]
_DATED = [["date"], ["debit"]]
_PADDED = {"left_of": "x1", "right_of": "x1", "spread": True}

# The words, phrases, points and distances by which each bank's header is known and cut.
PROFILES: dict[str, Profile] = {
    "providus": Profile(
        ["TXN", "VAL", "REMARKS", "DEBIT", "CREDIT", "BALANCE"],
        [Named("date", _one("TXN")), Named("value_date", _one("VAL")), Named("description", _one("REMARKS")), Named("debit", _one("DEBIT")), Named("credit", _one("CREDIT")), Named("balance", _one("BALANCE"))],
        [["date"]], count="words", parts=[_both(["description"], ["debit"], "after", -5)], first="open", last="open",
    ),
    "zenith": Profile(
        ["DATE", "POSTED", "VALUE", "NARRATION", "DESCRIPTION", "DEBIT", "CREDIT", "BALANCE"],
        [Named("date", _one("DATE")), Named("value_date", _one("VALUE")), Named("description", _one("NARRATION", "DESCRIPTION", "PARTICULARS")), Named("debit", _one("DEBIT", "DR")), Named("credit", _one("CREDIT", "CR")), Named("balance", _one("BALANCE", "BAL"))],
        _DATED, needed=[["DATE"], ["DEBIT", "CREDIT", "BALANCE"]], bonus=[(["DATE POSTED"], 2), (["VALUE DATE"], 2), (["DESCRIPTION"], 2)], count="whole",
    ),
    "wema": Profile(
        ["TRAN", "DATE", "VALUE", "NARRATION", "ID", "CHEQUE", "WITHDRAWALS", "DEPOSITS", "BALANCE"],
        [Named("date", _one("TRAN", "DATE")), Named("value_date", _one("VALUE")), Named("description", _one("NARRATION")), Named("reference", _one("ID")), Named("debit", _one("WITHDRAWAL", "DR")), Named("credit", _one("DEPOSIT", "CR")), Named("balance", _one("BALANCE"))],
        _DATED, needed=[["DATE"], ["WITHDRAWAL", "DEPOSIT", "BALANCE"]], bonus=[(["TRAN DATE"], 2), (["TRAN ID"], 2), (["CHEQUE NO"], 2)],
    ),
    "fcmb": Profile(
        ["TRAN", "DATE", "VALUE", "REF", "DETAILS", "DESCRIP", "DEBIT", "CREDIT", "WITHDRAWAL", "DEPOSIT", "BALANCE"],
        [Named("date", _one("TRAN", "DATE")), Named("value_date", _one("VALUE")), Named("reference", _one("REF")), Named("description", _one("DETAILS", "DESCRIP")), Named("debit", _one("DEBIT", "WITHDRAWAL")), Named("credit", _one("CREDIT", "DEPOSIT")), Named("balance", _one("BALANCE"))],
        _DATED, needed=[["DATE"], ["DETAILS", "DESCRIP"], [*_MONEY, "BALANCE"]], parts=[_both(_MOVES, _SUMS, "edges", 0)],
    ),
    "firstbank": Profile(
        ["TRANS", "DATE", "REF", "NUMBER", "DETAILS", "VALUE", "WITHDRAWAL", "DEPOSIT", "BALANCE"],
        [Named("date", _one("TRANS", "DATE")), Named("reference", _one("REF")), Named("description", _one("DETAILS")), Named("value_date", _one("VALUE")), Named("debit", _one("WITHDRAWAL", "WITHDRAW", "DR")), Named("credit", _one("DEPOSIT", "LODGEMENT", "CR")), Named("balance", _one("BALANCE"))],
        _DATED, needed=[["DATE"], ["WITHDRAWAL", "DEPOSIT", "BALANCE"]], bonus=[(["WITHDRAWAL", "(DR)"], 3), (["DEPOSIT", "(CR)"], 3), (["TRANSACTION DETAILS"], 2)], parts=[_both(_MOVES, ["credit", "balance"], "after", -5)],
    ),
    "ecobank": Profile(
        ["DATE", "VALUE", "DESCRIPTION", "NARRATION", "REMARK", "DETAILS", "PARTICULARS", "DEBIT", "WITHDRAWAL", "CREDIT", "DEPOSIT", "BALANCE"],
        [
            Named("date", [Look(r"^(TRANS|TRANSACTION|TRN)\.?\s*DATE", 2), Look(r"^(?!VAL).*DATE")], near=True), Named("value_date", [Look(r"VAL(UE)?\s*DATE"), Look(r"^VAL(UE)?\s+DATE$", 2)], near=True),
            Named("description", _one("DESCRIPTION|NARRATION|REMARKS?|DETAILS|PARTICULARS"), spread=True, near=True), Named("debit", _one(r"DEBIT|WITHDRAWAL|DR\b"), spread=True, near=True), Named("credit", _one(r"CREDIT|DEPOSIT|CR\b"), spread=True, near=True), Named("balance", _one(r"BALANCE|BAL\b"), spread=True, near=True),
        ],
        [["date"], ["description"], ["debit"], ["credit"], ["balance"]], banned=["ACCOUNT SUMMARY", "TOTAL CREDIT", "TOTAL DEBIT"], count="distinct", reach=6,
        parts=[_both(["date"], ["description"], "before", 2), _both(["description"], ["value_date", "debit"], "after", -2), _both(_MOVES, ["credit", "balance"], "after", 0), _both(["value_date"], ["debit"], "before", 3), _both(["date"], ["debit"], "before", -25), _both(["description"], ["date"], "mid", -15)], first="open", last="open",
    ),
    "uba": Profile(
        ["TRANSACTION", "TRANS", "VALUE", "DATE", "NARRATION", "REMARKS", "CHQ", "CHEQUE", "NUMBER", "REF", "DEBIT", "CREDIT", "BALANCE", "WITHDRAWAL", "DEPOSIT", "LODGEMENT", "DESCRIPTION", "DETAILS"],
        [Named("date", _one("^(?!.*VALUE).*DATE", "TRANS"), near=True), Named("value_date", _one("VALUE"), near=True), Named("description", _one("NARRATION", "REMARKS", "DESCRIPTION", "DETAILS"), near=True), Named("reference", _one("CHQ", "CHEQUE", "REF"), near=True), Named("debit", _one("DEBIT", "WITHDRAWAL"), near=True), Named("credit", _one("CREDIT", "DEPOSIT", "LODG"), near=True), Named("balance", _one("BALANCE"), near=True)],
        [["date"], ["debit", "credit"]], needed=[["DATE"], ["BALANCE"], _MONEY], least=4, below=["DATE", "NUMBER"], first="own", first_by=-5,
        parts=[Part(["value_date"], ["description"], "mid", 0, "before", 2), Part(["description"], ["*"], "after", -5, "mid", 0), _both(_MOVES, _SUMS, "edges", 0)],
    ),
    "access": Profile(
        ["DATE", "TRANSACTION", "DETAILS", "DESCRIPTION", "NARRATION", "REFERENCE", "REF", "VALUE", "WITHDRAWAL", "WITHDRAWALS", "DEBIT", "LODGEMENT", "LODGEMENTS", "CREDIT", "DEPOSIT", "DEPOSITS", "BALANCE", "BAL", "POSTED", "REMARKS"],
        [
            Named("date", _one("DATE|POSTED"), right_of="x0", right=40, spread=True, near=True), Named("description", _one("DETAILS|TRANSACTION|DESCRIPTION|NARRATION|REMARKS"), right_of="x0", right=60, spread=True, near=True), Named("reference", _one("REF"), right_of="x0", right=40, spread=True, near=True), Named("value_date", _one("VALUE"), right_of="x0", right=40, spread=True, near=True),
            Named("debit", _one("WITHDRAWAL|DEBIT"), left=-100, right=20, near=True, **_PADDED), Named("credit", _one("LODGEMENT|CREDIT|DEPOSIT"), left=-100, right=20, near=True, **_PADDED), Named("balance", _one("BAL"), left=-100, right=20, near=True, **_PADDED),
        ],
        [["date"], ["description"], ["debit", "credit"], ["balance"]], count="distinct", least=4, reach=8, latest=True,
    ),
    "fidelity": Profile(
        ["DETAILS", "BALANCE", "PAY", "TRANSACTION"],
        [
            Named("date", _one("TRANSACTION")), Named("value_date", _one("VALUE"), absent=[Absent("date", 10, 40)]), Named("channel", _one("CHANNEL"), absent=[Absent("value_date", 10, 50), Absent("date", 50, 90)]), Named("description", _one("DETAILS")),
            Named("credit", [Look("PAY.*IN"), Look(r"PAY.*\s.*IN", 2), Look(r"\bIN\b")], absent=[Absent("description", 50, 120)]), Named("debit", [Look("PAY.*OUT"), Look(r"PAY.*\s.*OUT", 2), Look(r"\bOUT\b")], absent=[Absent("credit", 10, 80), Absent("description", 130, 200)]), Named("balance", _one("BALANCE")),
        ],
        [["date"], ["description"], ["balance"]], count="distinct", first="own", first_by=-10, parts=[Part(["date"], ["value_date"], "mid", 0, "after", -15), Part(["description"], ["*"], "after", -5, "mid", 0)],
    ),
    "fidelity_amounts": Profile(
        ["DATE", "WITHDRAW", "DEBIT", "LODG", "DEPOSIT", "CREDIT", "BALANCE"],
        [
            Named("date", _one(r"^(?!VALUE).*DATE")), Named("description", _one("DETAILS|NARRATION|DESCRIPTION|PARTICULARS", "TRANSACTION")), Named("reference", _one("REF|CHQ")), Named("value_date", _one("VALUE")),
            Named("debit", _one(r"WITHDRAW|DEBIT|DR\b"), left=-80, right=5, **_PADDED), Named("credit", _one(r"LODG|DEPOSIT|CREDIT|CR\b"), left=-65, right=5, **_PADDED), Named("balance", _one(r"BALANCE|BAL\b"), left=-80, right=5, **_PADDED),
        ],
        [["date"], ["debit"], ["credit"], ["balance"]], needed=[["DATE"], ["WITHDRAW", "DEBIT"], ["LODG", "DEPOSIT", "CREDIT"], ["BALANCE"]], last="own", printed_order=True,
        parts=[_both(["value_date"], ["debit"], "after", 45), Part(["date", "description", "reference"], ["debit"], "after", 75, "after", 0), _both(["date", "description", "reference"], ["*"], "after", -5), Part(["debit", "credit"], ["*"], "before", 0, "after", 0)],
    ),
    "apt_securities": Profile(
        ["TXN", "DATE", "GL", "DESCRIPTION", "DEBIT", "CREDIT", "BALANCE"],
        [Named("date", _one("TXN|DATE")), Named("description", _one("GL|DESCRIPTION")), Named("debit", _one("DEBIT"), left=-80, right=5, **_PADDED), Named("credit", _one("CREDIT"), left=-80, right=5, **_PADDED), Named("balance", _one("BALANCE"), left=-80, right=5, **_PADDED)],
        [["date"], ["description"], ["debit"], ["credit"], ["balance"]], last="own", printed_order=True,
        parts=[_both(["date"], ["description"], "after", -10), Part(["description"], ["debit"], "after", -20, "after", 0), Part(["debit", "credit"], ["*"], "before", 0, "after", 0)],
    ),
    "gtco": Profile(
        ["TRANS", "VALUE", "REF", "DEB", "CRED", "BAL", "PARTICULARS", "REMARKS", "DETAILS", "BRANCH"],
        [
            Named("date", _one("TRANS"), right_of="x0", spread=True, near=True), Named("value_date", _one("VALUE"), right_of="x0", spread=True, near=True), Named("reference", _one("REFER"), right_of="x0", spread=True, near=True), Named("debit", _one("DEB"), near=True, **_PADDED), Named("credit", _one("CRED"), near=True, **_PADDED), Named("balance", _one("BAL"), near=True, **_PADDED),
            Named("branch", _one("ORIGINAT|BRANCH"), right_of="x0", spread=True, near=True), Named("description", _one("REMARKS?|PARTICULARS|DETAILS"), right_of="x0", spread=True, near=True),
        ],
        [["date"], ["debit"], ["credit"], ["balance"]], count="words", reach=25, first="open", last="open",
    ),
    "gtbank": Profile(
        ["TRANS", "VALUE", "REF", "DEB", "CRED", "BAL", "ORIGINAT", "BRANCH", "REMARKS"],
        [
            Named("date", _one("^TRANS"), right_of="x0", spread=True), Named("value_date", _one("^VALUE"), right_of="x0", spread=True), Named("reference", _one("^REF"), right_of="x0", spread=True), Named("debit", _one("^DEB"), **_PADDED), Named("credit", _one("^CRED"), **_PADDED), Named("balance", _one("^BAL"), **_PADDED),
            Named("branch", _one("ORIGINAT|BRANCH"), right_of="x0", spread=True), Named("description", _one("REMARKS?|PARTICULARS|DETAILS"), right_of="x0", spread=True),
        ],
        [["date"], ["debit"], ["credit"], ["balance"]], count="words", first="open", last="open",
    ),
    "sterling": Profile(
        ["NARRATION", "MONEY"],
        [Named("date", _one("DATE", "TRANS"), near=True), Named("description", _one("NARRATION")), Named("value_date", _one("VALUE"), near=True), Named("reference", _one("REF"), near=True), Named("credit", [Look(r"^MONEY\s*IN$"), Look(r"^MONEY\s+IN$", 2)]), Named("debit", [Look(r"^MONEY\s*OUT$"), Look(r"^MONEY\s+OUT$", 2), Look("^OUT$", shift=-30)]), Named("balance", _one("BALANCE"))],
        [["description"], ["credit"], ["debit"]], needed=[["NARRATION"], ["MONEY"]], count="first", least=1, reach=14, parts=[_both(["credit", "debit"], ["*"], "mid", 0), _both(["*"], ["*"], "after", -2)],
    ),
}

_LOOK = "struct<pattern:string, words:int, shift:double>"
_NAMED = f"struct<name:string, looks:array<{_LOOK}>, left_of:string, left:double, right_of:string, right:double, spread:boolean, near:boolean, absent:array<struct<of:string, left:double, right:double>>>"
_PART = "struct<before:array<string>, after:array<string>, end:string, end_by:double, start:string, start_by:double>"
_TYPE = f"map<string, struct<keywords:array<string>, fields:array<{_NAMED}>, required:array<array<string>>, needed:array<array<string>>, banned:array<string>, bonus:array<struct<phrases:array<string>, points:int>>, count:string, least:int, reach:double, below:array<string>, latest:boolean, parts:array<{_PART}>, first:string, first_by:double, last:string, printed_order:boolean>>"


def _literal(profiles: dict[str, Profile]) -> Column:
    rows = {name: asdict(p) | {"bonus": [{"phrases": phrases, "points": points} for phrases, points in p.bonus]} for name, p in profiles.items()}
    return F.from_json(F.lit(json.dumps(rows)), _TYPE)


def _found(named: Column, words: Column) -> Column:
    """The place of a column's words on the header: the first look that any word or pair of neighbours meets."""
    seen = F.filter(words, lambda w: named["near"] | w["own"])

    def place(look: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(seen) - 1),
            lambda i: F.struct(F.concat_ws(" ", F.element_at(seen, i)["t"], F.element_at(seen, i + 1)["t"]).alias("t"), F.element_at(seen, i)["x0"].alias("x0"), F.element_at(seen, i + 1)["x1"].alias("x1")),
        )
        single = F.transform(seen, lambda w: F.struct(w["t"].alias("t"), w["x0"].alias("x0"), w["x1"].alias("x1")))
        pool = F.when(look["words"] == 1, single).when(F.size(seen) > 1, pairs).otherwise(F.filter(single, lambda w: F.lit(False)))
        hits = F.filter(pool, lambda w: F.regexp_like(w["t"], look["pattern"]))
        return F.when(F.size(hits) > 0, F.struct((F.get(hits, F.lit(0))["x0"] + look["shift"]).alias("x0"), F.when(named["spread"], F.array_max(F.transform(hits, lambda w: w["x1"]))).otherwise(F.get(hits, F.lit(0))["x1"]).alias("x1")))

    return F.get(F.filter(F.transform(named["looks"], place), lambda p: p.isNotNull()), F.lit(0))


def header_cuts(words: DataFrame, profiles: dict[str, Profile] = PROFILES) -> DataFrame:
    """``words(file_id, page_no, line_id, top, word_seq, text, x0, x1, bank)`` -> ``(file_id, page_no, bank, score, col_ord, col_name,
    x_left, x_right)`` of the elected line of each page and bank; several banks may be tried on one page (rows of each), for LAY-15.

    The line with the highest score is the header; of equals the topmost (the lowest where a profile says so). Texts are compared in
    upper case without soft hyphens. Pages without a line that meets the profile, without its required columns, or of a bank
    without a profile: no rows. Null texts count as empty; words without a place are left out; repeated words count twice.
    """
    page, line = ["file_id", "page_no", "bank"], ["file_id", "page_no", "bank", "line_id"]
    at = words.where(F.col("bank").isin(list(profiles)) & F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("top").isNotNull()).repartition(*page)
    word = F.struct("x0", "word_seq", "x1", F.upper(F.replace(F.coalesce("text", F.lit("")), F.lit("\u00ad"), F.lit(""))).alias("t"))
    lines = at.groupBy(*line).agg(F.min("top").alias("top"), F.array_sort(F.collect_list(word)).alias("ws")).withColumn("p", _literal(profiles)[F.col("bank")])
    p, text = F.col("p"), F.concat_ws(" ", F.transform("ws", lambda w: w["t"]))
    lines = lines.withColumn("text", text).withColumn("keys", F.filter(p["keywords"], lambda k: F.contains("text", k)))
    around = Window.partitionBy(*page).orderBy("top").rangeBetween(-25, 25)
    ordered = Window.partitionBy(*page).orderBy("top", "line_id")
    lines = lines.withColumn("near", F.collect_list(F.struct("top", "keys")).over(around)).withColumn("rank", F.row_number().over(ordered))
    count = p["count"]
    hits = lambda test: F.aggregate("ws", F.lit(0), lambda n, w: n + F.size(F.filter(p["keywords"], lambda k: test(w["t"], k))))
    counted = (
        F.when(count == "pairs", hits(F.contains))
        .when(count == "whole", hits(lambda t, k: t == k))
        .when(count == "words", F.size(F.filter("ws", lambda w: F.exists(p["keywords"], lambda k: F.contains(w["t"], k)))))
        .when(count == "distinct", F.size(F.array_distinct(F.flatten(F.transform(F.filter("near", lambda n: F.abs(n["top"] - F.col("top")) <= p["reach"]), lambda n: n["keys"])))))
        .otherwise(F.lit(1))
    )
    bonus = F.aggregate(F.filter(p["bonus"], lambda b: F.forall(b["phrases"], lambda s: F.contains("text", s))), F.lit(0), lambda n, b: n + b["points"])
    fits = F.forall(p["needed"], lambda g: F.exists(g, lambda s: F.contains("text", s))) & ~F.exists(p["banned"], lambda s: F.contains("text", s)) & (F.size("keys") > 0)
    lines = lines.withColumn("score", F.when(fits, counted + bonus)).withColumn("score", F.when(F.col("score") >= p["least"], F.col("score")))
    whole = Window.partitionBy(*page)
    turn = F.when(p["latest"], F.col("rank")).otherwise(-F.col("rank"))
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", turn.alias("turn"), "top", "rank"))).over(whole)
    lines = lines.drop("near").withColumn("best", best).where("best is not null")
    own = F.col("rank") == F.col("best.rank")
    below = (F.col("rank") == F.col("best.rank") + 1) & F.exists(p["below"], lambda s: F.contains("text", s))
    close = (p["reach"] > 0) & (F.abs(F.col("top") - F.col("best.top")) <= p["reach"])
    lines = lines.where(own | below | close)
    marked = F.transform("ws", lambda w: F.struct(w["x0"].alias("x0"), F.col("rank").alias("rank"), w["word_seq"].alias("word_seq"), w["x1"].alias("x1"), w["t"].alias("t"), own.alias("own")))
    heads = lines.groupBy(*page).agg(F.first("p").alias("p"), F.first("best.score").alias("score"), F.array_sort(F.flatten(F.collect_list(marked))).alias("words"))

    places = heads.withColumn("found", F.transform(p["fields"], lambda n: F.struct(n.alias("n"), _found(n, F.col("words")).alias("at"))))
    known = lambda name: F.get(F.filter("found", lambda f: (f["n"]["name"] == name) & f["at"].isNotNull()), F.lit(0))["at"]

    def guessed(f: Column) -> Column:
        from_other = F.filter(F.transform(f["n"]["absent"], lambda a: F.when(known(a["of"]).isNotNull(), F.struct((known(a["of"])["x1"] + a["left"]).alias("x0"), (known(a["of"])["x1"] + a["right"]).alias("x1")))), lambda g: g.isNotNull())
        spot = F.coalesce(f["at"], F.get(from_other, F.lit(0)))
        edge = lambda which: F.when(f["n"][which] == "x0", spot["x0"]).otherwise(spot["x1"])
        left = edge("left_of") + f["n"]["left"]
        return F.when(spot.isNotNull(), F.struct(F.when(p["printed_order"], spot["x0"]).otherwise(left).alias("key"), f["n"]["name"].alias("name"), left.alias("l"), (edge("right_of") + f["n"]["right"]).alias("r")))

    has = F.transform(F.filter("found", lambda f: f["at"].isNotNull()), lambda f: f["n"]["name"])
    complete = F.forall(p["required"], lambda g: F.arrays_overlap(has, g))
    cols = F.array_sort(F.filter(F.transform("found", guessed), lambda c: c.isNotNull()))
    placed = places.where(complete).withColumn("cols", cols).select(*page, "score", "p", "cols", F.posexplode("cols").alias("col_ord", "c"))

    def parted(before: Column, after: Column, side: str) -> Column:
        is_in = lambda names, c: F.array_contains(names, c["name"]) | F.array_contains(names, F.lit("*"))
        rule = F.get(F.filter(p["parts"], lambda r: is_in(r["before"], before) & is_in(r["after"], after)), F.lit(0))
        how, by = rule[side], F.coalesce(rule[f"{side}_by"], F.lit(0.0))
        return F.when(how == "after", after["l"] + by).when(how == "before", before["r"] + by).when(how == "edges", (before["r"] + after["r"]) / 2 + by).otherwise((before["r"] + after["l"]) / 2 + by)

    c, i = F.col("c"), F.col("col_ord")
    first = F.when(p["first"] == "zero", 0.0).when(p["first"] == "open", -FAR).otherwise(F.greatest(F.lit(0.0), c["l"] + p["first_by"]))
    last = F.when(p["last"] == "thousand", 1000.0).when(p["last"] == "open", FAR).otherwise(c["r"])
    left = F.when(i == 0, first).otherwise(parted(F.get("cols", i - 1), c, "start"))
    right = F.when(i == F.size("cols") - 1, last).otherwise(parted(c, F.get("cols", i + 1), "end"))
    return placed.select(*page, "score", "col_ord", c["name"].alias("col_name"), left.alias("x_left"), right.alias("x_right"))
