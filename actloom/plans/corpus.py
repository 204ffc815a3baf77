"""Court-act inputs derived from the order tables.

Customers and orders give act pages; orders and line items give model replies and
answers. So the Russian-language stages run on any scale factor and their work
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.lexicon.ru_acts import DATES

LAST_PAGE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_number(key: Column) -> Column:
    return F.concat(
        F.lit("А"), (key % 90 + 10).cast("string"), F.lit("-"), key.cast("string"), F.lit("/"),
        (key % 7 + 2015).cast("string"),
    )


def act_date(key: Column) -> Column:
    months = F.array(*[F.lit(m) for m in DATES.months])
    return F.concat_ws(
        " ", (key % 28 + 1).cast("string"), F.get(months, (key % 12).cast("int")), (key % 7 + 2015).cast("string"),
        F.lit("года"),
    )


def first_pages(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("АРБИТРАЖНЫЙ СУД УРАЛЬСКОГО ОКРУГА\nПОСТАНОВЛЕНИЕ\n"),
        act_date(k), F.lit(" Дело № "), case_number(k),
        F.lit("\nАрбитражный суд в составе судей Ивановой А.А., Петрова Б.Б. рассмотрел жалобу по заявлению "
              "общества с ограниченной ответственностью «Клиент "),
        k.cast("string"),
        F.lit("» о включении требования в реестр требований кредиторов в рамках дела о несостоятельности "
              "(банкротстве) общества с ограниченной ответственностью «Должник "),
        k.cast("string"),
        F.lit("»\nустановил:\nВ рамках дела о банкротстве открыто конкурсное производство.\n"
              "В кассационной жалобе заявитель просит отменить судебные акты.\n"
              "Изучив материалы дела, суд округа приходит к следующим выводам."),
    )
    return customers.select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


def last_pages(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("7 "), case_number(k), F.lit("\nПОСТАНОВИЛ:\nОставить судебные акты без изменения."))
    return customers.select(k.alias("doc_id"), F.lit(LAST_PAGE).alias("page"), text.alias("text"))


def line_pages(orders: DataFrame) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    text = F.concat(
        F.lit("Платеж П"), key.cast("string"), F.lit(" от "), F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.lit(" подтвержден.\n"),
        F.repeat(F.lit("Довод проверен судами.\n"), (key % 4).cast("int")),
        F.when(status == "O", "Вопрос разрешен по правилам статьи 71 АПК РФ.\n").otherwise(""),
        F.when(status == "P", "Срок истек в 2019 года.\n").otherwise(""),
        F.lit("стр. "), (key % 100 + 1).cast("string"),
    )
    page = (key % 900_000_000 + 2).cast("int")
    return orders.select(F.col("o_custkey").alias("doc_id"), page.alias("page"), text.alias("text"))


def act_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows of the derived acts: an act per customer, a page per order."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    pages = first_pages(customers).unionByName(last_pages(customers)).unionByName(line_pages(orders))
    return pages.withColumn("tables", F.array().cast("array<string>"))


# ------------------------------------------------------------- model replies

def line_seq() -> Column:
    """Order of the line items of an order (a total order)."""
    return (
        F.col("l_linenumber").cast("bigint") * F.lit(10**12)
        + F.col("l_partkey") * F.lit(10**5)
        + F.col("l_suppkey")
    )


PHRASES = (
    ("A", "F", "Договор займа подписан сторонами и исполнен банковскими переводами."),
    ("A", "O", "Кредитор контролировал должника через участие в уставном капитале."),
    ("N", "F", "Суд пришел к выводу о реальности поставки по накладным."),
    ("N", "O", "Первичные документы отсутствуют, передача товара ничем не подтверждена."),
    ("R", "F", "Кризис наступил раньше спорной сделки, имущества уже не хватало."),
    ("R", "O", "Требование понижено в очередности как компенсационное финансирование."),
)


def phrase() -> Column:
    out = F.lit(None).cast("string")
    for flag, status, text in PHRASES:
        out = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), text).otherwise(out)
    return out


def spread(spark: SparkSession, df: DataFrame, key: str = "l_orderkey") -> DataFrame:
    """Small files, costly parsing behind: spread rows over all partitions."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model reply per line item, in the sectioned reply format."""
    lines = spread(spark, table(spark, sf_dir, "lineitem"))
    card = F.when(F.col("l_linenumber") % 2 == 0, "claimAndDealCard").otherwise("courtAssessmentCard")
    text = F.concat(
        F.lit("ENTITY_MAP:\nООО Поставщик "), (F.col("l_suppkey") % 10).cast("string"),
        F.lit(" — "), F.when(F.col("l_linestatus") == "O", "кредитор; юридическое лицо").otherwise("юридическое лицо"),
        F.lit("\nCARD_BLOCKS:\n[send_to: "), card, F.lit("]\n- "), phrase(),
        F.lit("\n- Дата отгрузки указана в накладной.\n"),
    )
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        line_seq().alias("annotation_seq"),
        F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("window_id"),
        F.lit("z004").alias("zone_id"),
        F.lit("court_reasoning").alias("zone_type"),
        F.array(F.date_format("l_shipdate", "dd.MM.yyyy")).alias("dates"),
        F.array(F.format_string("s%05d", F.col("l_linenumber"))).alias("sentence_ids"),
        F.array(F.format_string("s%05d", F.col("l_linenumber"))).alias("date_sentence_ids"),
        text.alias("annotation_text"),
    )


# ------------------------------------------------------------- model answers

def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON answer per line item; values, quotes and wrappers vary by column."""
    lines = spread(spark, table(spark, sf_dir, "lineitem"))
    qty, part, supp = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey")

    def pick(n: Column, *values: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))

    def feature(value: Column, quote: Column, source: str = "zone=court_reasoning") -> Column:
        return F.struct(
            value.alias("value"), quote.alias("evidence_quote"), F.lit(source).alias("evidence_source"),
            F.lit("high").alias("confidence"),
        )

    quote = F.when(part % 7 == 0, "").otherwise("цитата")
    body = F.struct(
        F.struct(
            feature(pick(qty, "loan", "supply", "cession", "unknown"), quote).alias("claim_type"),
            feature(pick(part, "real_deal", "compensation_financing", "unknown"), F.lit("цитата")).alias("claim_origin"),
        ).alias("claim"),
        F.struct(
            feature(pick(supp, "independent", "affiliated", "controlling"), F.lit("цитата")).alias("creditor_status"),
            feature(pick(part + supp, "да", "нет", "true", "не установлено"), F.lit("цитата")).alias("control_found"),
        ).alias("creditor_profile"),
        F.struct(
            feature(pick(part, "yes", "no", "unknown", "yes"), F.lit("цитата")).alias("court_recognized_debt_real"),
        ).alias("proof"),
        F.struct(
            feature(pick(supp, "included_general", "refused", "remand"), F.lit("цитата")).alias("legal_qualification"),
            feature(pick(qty, "market_behavior", "corporate_nature", "procedural_remand"), F.lit("цитата")).alias(
                "key_reason_category"
            ),
        ).alias("qualification"),
    )
    json = F.to_json(body)
    wrapped = (
        F.when(supp % 11 == 0, F.concat(F.lit('{"result":['), json, F.lit("]}")))
        .when(supp % 11 == 1, F.concat(F.lit('{"annotation":'), json, F.lit("}")))
        .when(supp % 97 == 2, "not json")
        .otherwise(json)
    )
    return lines.select(
        F.col("l_orderkey").alias("doc_id"), line_seq().alias("extractor_seq"), F.lit("line").alias("extractor"),
        wrapped.alias("answer_text"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped"),
    )


def shaped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per line item whose shapes vary by key: the same field is a feature, an object of features, a
    list or a plain text; a section is a list or an object; some answers have sections of their own."""
    lines = spread(spark, table(spark, sf_dir, "lineitem"))
    third = lambda c: (F.col(c).cast("int") % 3).cast("string")
    part, qty, supp = third("l_partkey"), third("l_quantity"), F.col("l_suppkey")

    def feature(value: Column) -> Column:
        rest = '","evidence_quote":"цитата","evidence_source":"zone=court_reasoning","confidence":"high"}'
        return F.concat(F.lit('{"value":"'), value, F.lit(rest))

    terms = (
        F.when(supp % 4 == 0, feature(F.concat(F.lit("t"), part)))
        .when(supp % 4 == 1, F.concat(
            F.lit('{"rate":'), feature(F.concat(F.lit("r"), part)), F.lit(',"period":{"days":'), feature(F.concat(F.lit("d"), qty)), F.lit("}}")))
        .when(supp % 4 == 2, F.concat(F.lit('["l'), part, F.lit('","l'), qty, F.lit('"]')))
        .otherwise(F.concat(F.lit('"plain'), part, F.lit('"')))
    )
    motives = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit('["m'), part, F.lit('","m'), qty, F.lit('"]'))).otherwise(
        F.concat(F.lit('{"motivation_crisis":'), feature(F.lit("да")), F.lit("}"))
    )
    extra = (
        F.when(supp % 7 == 3, ',"lishnee":{}')
        .when(supp % 7 == 4, F.concat(F.lit(',"economic_dispute":{"economic_dispute_basket":'), feature(F.lit("mixed")), F.lit("}")))
        .when(supp % 7 == 5, F.concat(F.lit(',"annotation":{"strange":{},"claim":{"claim_type":'), feature(F.lit("loan")), F.lit("}}")))
        .otherwise("")
    )
    body = F.concat(F.lit('{"market_terms":{"terms":'), terms, F.lit('},"motivation":'), motives, extra, F.lit("}"))
    return lines.select(
        F.col("l_orderkey").alias("doc_id"), line_seq().alias("extractor_seq"), F.lit("line").alias("extractor"),
        F.when(supp % 7 == 5, F.concat(F.lit('{"annotation":'), body, F.lit("}"))).otherwise(body).alias("answer_text"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped"),
    )


# ------------------------------------------------------- answers about the acts

#: Values of the required fields in the answers about acts; the claim's type comes apart.
ACT_VALUES = (
    ("claim", "claim_origin", "real_deal"), ("creditor_profile", "creditor_status", "independent"),
    ("creditor_profile", "formal_affiliation_found", "no"), ("creditor_profile", "factual_affiliation_found", "no"),
    ("creditor_profile", "control_found", "no"), ("crisis", "crisis_status", "no_crisis"),
    ("proof", "performance_fact_proven", "yes"), ("proof", "court_recognized_debt_real", "yes"),
    ("proof", "court_doubted_reality", "no"), ("proof", "court_found_sham_or_artificial", "no"),
    ("qualification", "legal_qualification", "included_general"), ("qualification", "key_reason_category", "market_behavior"),
)


def _act_feature(value: Column, quote: str = "цитата") -> Column:
    return F.struct(
        value.alias("value"), F.lit(quote).alias("evidence_quote"), F.lit("zone=court_reasoning").alias("evidence_source"),
        F.lit("high").alias("confidence"),
    )


def act_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about the act of a customer: all required fields; the claim's type is known for keys 0 and 1 of 5,
    contradicted by a second answer for key 1, and unknown for the others."""
    k = F.col("c_custkey")
    claim = _act_feature(F.when(k % 5 < 2, "cession").otherwise("unknown")).alias("claim_type")
    sections = dict.fromkeys(s for s, _, _ in ACT_VALUES)
    fields = {s: [_act_feature(F.lit(v)).alias(f) for t, f, v in ACT_VALUES if t == s] for s in sections}
    body = F.struct(*(F.struct(*([claim] if s == "claim" else []), *fs).alias(s) for s, fs in fields.items()))
    second = F.when(k % 5 == 1, F.to_json(F.struct(F.struct(_act_feature(F.lit("loan")).alias("claim_type")).alias("claim"))))
    customers = spread(spark, table(spark, sf_dir, "customer"), "c_custkey")
    rows = customers.select(k.alias("doc_id"), F.posexplode(F.array(F.to_json(body), second)).alias("i", "answer_text"))
    return rows.filter("answer_text IS NOT NULL").select(
        "doc_id", F.col("i").cast("bigint").alias("extractor_seq"), F.lit("claimEconomics").alias("extractor"), "answer_text",
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped"),
    )


def act_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about acts, one for each order of a customer; they name a sentence that the act may have or not."""
    k = F.col("o_orderkey")
    ids = F.array(F.concat(F.lit("s"), F.lpad((k % 40 + 5).cast("string"), 5, "0")))
    card = F.get(F.array(*[F.lit(c) for c in ("claimAndDealCard", "courtAssessmentCard", "proofAndEvidenceCard")]), (k % 3).cast("int"))
    text = F.concat(F.lit("CARD_BLOCKS:\n[send_to: "), card, F.lit("]\n- Платеж П"), k.cast("string"), F.lit(" подтвержден судами.\n"))
    # By order, not by customer: a hot customer's replies are parsed by many tasks.
    return spread(spark, table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_custkey").alias("doc_id"), k.alias("annotation_seq"), F.concat(F.lit("w"), k.cast("string")).alias("window_id"),
        F.lit("z004").alias("zone_id"), F.lit("court_reasoning").alias("zone_type"),
        F.array(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("dates"), ids.alias("sentence_ids"), ids.alias("date_sentence_ids"),
        text.alias("annotation_text"),
    )


def act_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the refill of acts whose claim's type is unknown: with a quote for keys 2 and 3 of 5, without
    one for key 4, and an error for every seventh act."""
    k = F.col("c_custkey")
    answer = F.when(k % 5 == 4, F.to_json(F.struct(F.struct(_act_feature(F.lit("cession"), "").alias("claim_type")).alias("claim")))).otherwise(
        F.to_json(F.struct(F.struct(_act_feature(F.lit("cession")).alias("claim_type")).alias("claim")))
    )
    return spread(spark, table(spark, sf_dir, "customer").filter(k % 5 > 1), "c_custkey").select(
        k.alias("doc_id"), F.lit(0).cast("bigint").alias("extractor_seq"), F.lit("claimEconomics").alias("extraction_type"),
        F.array(F.lit("annotation.claim.claim_type")).alias("target_paths"), answer.alias("answer_text"),
        F.when(k % 7 == 0, "timeout").alias("error"),
    )


# ------------------------------------------------------------- files and replies

def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files, one of each customer's orders: arrays, wrapped arrays and broken ones, with some bad records."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    record = F.to_json(F.struct(
        F.concat(F.lit("s"), o.cast("string")).alias("sentence_id"), F.dayofmonth("o_orderdate").alias("global_index"),
        F.col("o_orderpriority").alias("text"), F.array(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("dates"),
    ))
    item = F.when(o % 13 == 0, "17").when(o % 13 == 1, '{"sentence_id":"s","global_index":"first"}').otherwise(record)
    rows = table(spark, sf_dir, "orders").groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(F.struct(o.alias("o"), item.alias("r")))).alias("x"))
    array = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["r"]), ","), F.lit("]"))
    value = (
        F.when(F.col("k") % 11 == 0, F.concat(F.lit("{"), array)).when(F.col("k") % 11 == 1, F.lit('{"other":[]}'))
        .when(F.col("k") % 11 == 2, F.concat(F.lit('{"sentences":'), array, F.lit("}"))).otherwise(array)
    )
    return rows.select(F.concat(F.lit("acts/c"), F.col("k").cast("string"), F.lit(".json")).alias("file"), value.alias("value"))


def window_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("window_id"),
        F.col("o_orderkey").alias("annotation_seq"),
    )


def window_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to the requests, one attempt for each line item: some fail, some come empty, orders of key 0 of 7
    get none, and one in ten is to a window that nobody asked for."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id"))
    failed = (o + n) % 3 == 0
    return table(spark, sf_dir, "lineitem").filter(o % 7 != 0).join(orders, "l_orderkey").select(
        "doc_id", F.concat(F.when(o % 10 == 9, "x").otherwise("w"), o.cast("string")).alias("window_id"),
        n.cast("bigint").alias("attempt"),
        F.when(failed, F.lit(None).cast("string")).when((o + n) % 3 == 1, "").otherwise(F.concat(F.lit("reply "), n.cast("string"))).alias("annotation_text"),
        F.when(failed, F.concat(F.lit("timeout "), n.cast("string"))).alias("error"),
    )
