"""Query of header lines by profiles of banks. Printed headers are hung on the statements of the ledger; the SQL states, by hand, where a
reader of each bank's pages would cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import header_profiles
from ledgerflow.plans.fixtures import LEDGER_SQL, META_SQL, statement_meta
from ledgerflow.plans.registry import query

# Lines of a page as printed, from above: the line's height, and text, left and right edge of its words; then the score of the elected
# line and the cuts of its columns.
Line = tuple[float, list[tuple[str, float, float]]]
SAMPLES: dict[str, tuple[list[Line], int, list[tuple[str, float, float]]]] = {
    "providus": (
        [(80, [("DEBIT", 20, 50), ("of", 52, 60), ("BALANCE", 62, 90)]), (100, [("TXN DATE", 20, 70), ("VAL DATE", 90, 140), ("REMARKS", 160, 210), ("DEBIT", 300, 340), ("CREDIT", 400, 450), ("BALANCE", 500, 560)])],
        6, [("date", -10000, 80), ("value_date", 80, 150), ("description", 150, 295), ("debit", 295, 370), ("credit", 370, 475), ("balance", 475, 10000)],
    ),
    "zenith": (
        [(80, [("DEBIT", 20, 50), ("CREDIT", 52, 90), ("BALANCE", 92, 130), ("BALANCE", 140, 160)]), (100, [("Date", 20, 50), ("Posted", 52, 90), ("Value", 110, 140), ("Date", 142, 170), ("Description", 200, 280), ("Debit", 350, 390), ("Credit", 430, 480), ("Balance", 520, 580)])],
        14, [("date", 0, 80), ("value_date", 80, 170), ("description", 170, 315), ("debit", 315, 410), ("credit", 410, 500), ("balance", 500, 1000)],
    ),
    "wema": (
        [(80, [("Account", 20, 80), ("Summary", 90, 160)]), (100, [("Tran", 20, 48), ("Date", 50, 82), ("Narration", 150, 220), ("ID", 300, 318), ("Withdrawals", 420, 500), ("Deposits", 560, 625), ("Balance", 690, 750)])],
        9, [("date", 0, 99), ("description", 99, 260), ("reference", 260, 369), ("debit", 369, 530), ("credit", 530, 657.5), ("balance", 657.5, 1000)],
    ),
    "fcmb": (
        [(80, [("Value", 20, 50), ("Debit", 52, 80), ("Credit", 90, 120), ("Balance", 130, 170), ("Tran", 180, 200), ("Ref", 210, 230), ("Details", 240, 270), ("Deposit", 280, 300), ("Withdrawal", 310, 350)]), (100, [("Tran", 20, 45), ("Date", 47, 70), ("Value", 90, 120), ("Date", 122, 145), ("Details", 170, 220), ("Debit", 300, 330), ("Credit", 400, 440), ("Balance", 500, 550)])],
        8, [("date", 0, 67.5), ("value_date", 67.5, 145), ("description", 145, 260), ("debit", 260, 385), ("credit", 385, 495), ("balance", 495, 1000)],
    ),
    "firstbank": (
        [(90, [("Date", 20, 45), ("Balance", 60, 90), ("Value", 100, 130)]), (100, [("TransDate", 20, 60), ("Ref", 80, 100), ("Transaction", 120, 180), ("Details", 182, 220), ("Value", 240, 270), ("Withdrawal(DR)", 300, 370), ("Deposit(CR)", 400, 460), ("Balance", 500, 550)])],
        17, [("date", 0, 70), ("reference", 70, 141), ("description", 141, 230), ("value_date", 230, 285), ("debit", 285, 395), ("credit", 395, 495), ("balance", 495, 1000)],
    ),
    "ecobank": (
        [(100, [("Date", 20, 45), ("Value", 50, 70), ("Total", 80, 100), ("Credit", 102, 130), ("Debit", 140, 160), ("Details", 170, 200), ("Narration", 210, 240), ("Balance", 250, 280)]), (200, [("Transaction", 20, 70), ("Date", 72, 95), ("Description", 120, 180), ("Value", 300, 325), ("Date", 327, 350), ("Debit", 400, 430), ("Credit", 450, 485)]), (204, [("Balance", 520, 560)])],
        6, [("date", -10000, 97), ("description", 97, 298), ("value_date", 298, 353), ("debit", 353, 450), ("credit", 450, 520), ("balance", 520, 10000)],
    ),
    "uba": (
        [(100, [("Transaction", 20, 80), ("Value", 100, 125), ("Date", 127, 145), ("Cheque", 150, 190), ("Transaction", 210, 270), ("Remarks", 272, 310), ("Withdrawal", 330, 390), ("Deposit", 410, 450), ("Balance", 470, 520)]), (110, [("Date", 20, 45), ("Number", 150, 192)]), (120, [("Date", 5, 15)])],
        11, [("date", 15, 72.5), ("value_date", 72.5, 137.5), ("reference", 137.5, 231), ("description", 231, 325), ("debit", 320, 420), ("credit", 420, 485), ("balance", 485, 1000)],
    ),
    "access": (
        [(100, [("Posted", 20, 50), ("Value", 80, 105), ("Narration", 150, 200), ("Reference", 250, 300)]), (105, [("Withdrawals", 320, 385), ("Lodgements", 420, 466), ("Balance", 509, 562)]), (114, [("Date", 5, 15)])],
        11, [("date", 0, 70), ("value_date", 70, 135), ("description", 135, 230), ("reference", 230, 287.5), ("debit", 287.5, 385.5), ("credit", 385.5, 474), ("balance", 474, 1000)],
    ),
    "fidelity": (
        [(100, [("Transaction", 20, 70), ("Date", 72, 92), ("Value", 100, 125), ("Date", 127, 145), ("Details", 220, 260), ("Pay", 330, 345), ("In", 347, 357), ("Pay", 400, 415), ("Out", 417, 432), ("Balance", 480, 520)])],
        4, [("date", 10, 85), ("value_date", 85, 130), ("channel", 130, 197.5), ("description", 197.5, 325), ("credit", 295, 378.5), ("debit", 378.5, 456), ("balance", 456, 1000)],
    ),
    "fidelity_amounts": (
        [(100, [("Date", 20, 45), ("Details", 100, 140), ("Reference", 250, 300), ("Value", 480, 505), ("Withdrawals", 500, 550), ("Lodgements", 580, 640), ("Balance", 690, 740)])],
        4, [("date", 0, 95), ("description", 95, 245), ("reference", 245, 475), ("value_date", 475, 515), ("debit", 515, 555), ("credit", 575, 645), ("balance", 660, 745)],
    ),
    "apt_securities": (
        [(100, [("Txn", 20, 40), ("Date", 42, 60), ("GL", 120, 135), ("Description", 137, 190), ("Debit", 350, 380), ("Credit", 430, 465), ("Balance", 520, 560)])],
        7, [("date", 0, 110), ("description", 110, 280), ("debit", 300, 385), ("credit", 385, 470), ("balance", 480, 565)],
    ),
    "gtco": (
        [(90, [("Originating", 520, 570)]), (100, [("Trans­", 20, 45), ("Value", 80, 105), ("Refer­ence", 140, 180), ("D­ebit", 250, 280), ("Credit", 330, 365), ("Balance", 420, 460)]), (110, [("Date", 20, 40), ("Remarks", 600, 650)]), (130, [("Balance", 900, 950)])],
        6, [("date", -10000, 50), ("value_date", 50, 110), ("reference", 110, 210), ("debit", 210, 322.5), ("credit", 322.5, 412.5), ("balance", 412.5, 490), ("branch", 490, 560), ("description", 560, 10000)],
    ),
    "gtbank": (
        [(90, [("Balance", 20, 50), ("as", 52, 60), ("at", 62, 70), ("Last", 72, 90), ("Transaction", 92, 140)]), (100, [("Trans.", 20, 45), ("Value", 80, 105), ("Reference", 140, 180), ("Debits", 250, 280), ("Credits", 330, 365), ("Balance", 420, 460), ("Remarks", 600, 650)])],
        7, [("date", -10000, 50), ("value_date", 50, 110), ("reference", 110, 210), ("debit", 210, 322.5), ("credit", 322.5, 412.5), ("balance", 412.5, 530), ("description", 530, 10000)],
    ),
    "sterling": (
        [(94, [("Trans", 29, 50), ("Value", 298, 320)]), (100, [("Narration", 80, 130), ("Money", 350, 375), ("In", 377, 385), ("Money", 425, 450), ("Out", 452, 467), ("Balance", 510, 550)]), (106, [("Date", 29, 45), ("Date", 298, 315)]), (130, [("Narration", 80, 130), ("Money", 10, 20)])],
        1, [("date", 0, 78), ("description", 78, 296), ("value_date", 296, 348), ("credit", 348, 405), ("debit", 405, 488.5), ("balance", 488.5, 1000)],
    ),
    "elsewhere": ([(100, [("Date", 20, 45), ("Debit", 60, 90), ("Credit", 100, 130), ("Balance", 140, 180)])], 0, []),
}
_CUTS = ", ".join(f"({k}, '{bank}', {score}, {i}, '{c}', {a}, {b})" for k, (bank, (_, score, cuts)) in enumerate(SAMPLES.items()) for i, (c, a, b) in enumerate(cuts))


@query("lay_14_bank_headers", f"WITH {LEDGER_SQL}, {META_SQL} SELECT stmt_id AS file_id, bk AS bank, CAST(score AS INT) AS score, CAST(i AS INT) AS col_ord, c AS col_name, CAST(a AS DOUBLE) AS x_left, CAST(b AS DOUBLE) AS x_right FROM statement_meta JOIN (VALUES {_CUTS}) t(k, bk, score, i, c, a, b) ON k = stmt_id % {len(SAMPLES)}")
def _(spark, sf_dir):
    at = lambda line, top, seq, text, x0, x1: F.struct(F.lit(line).alias("line_id"), F.lit(float(top)).alias("top"), F.lit(seq).alias("word_seq"), F.lit(text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    pages = [F.array(*[at(n, top, seq, *w) for n, (top, words) in enumerate(lines) for seq, w in enumerate(words)]) for lines, *_ in SAMPLES.values()]
    k = (F.col("stmt_id") % len(SAMPLES) + 1).cast("int")
    m = statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"), F.lit(0).alias("page_no"), F.element_at(F.array(*map(F.lit, SAMPLES)), k).alias("bank"), F.explode(F.element_at(F.array(*pages), k)).alias("w"))
    return header_profiles.header_cuts(m.select("file_id", "page_no", "bank", "w.*")).drop("page_no")
