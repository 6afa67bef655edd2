"""News: concepts of a text, their heat, and what they say about stocks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.scalars import clean_text, json_strings, joined_hash, occurrences, parse_heat

from tidebar.sources.scratch import stored

from .mentions import stock_mentions

#: Fixed value: concepts of a news row at most.
MOST_CONCEPTS = 10
#: Credibility level of sources (1 best), 5 for others.
CREDIBILITY = {
    "eastmoney": 3, "ths": 4, "caixin": 2, "yicai": 2, "eeo": 2, "21jingji": 2, "caijing": 2, "ce": 3,
    "jwview": 3, "stcn": 2, "cnstock": 2, "sina": 4, "xueqiu": 6, "jiemian": 3, "hexun": 4, "stockstar": 4,
}
#: Words that mark news as driven by a message.
MESSAGE_KEYWORDS = (
    "公告", "利好", "重大", "重组", "并购", "收购", "借壳", "中标", "合同", "订单", "业绩", "预增", "扭亏",
    "涨价", "政策", "获批", "批复", "新药", "临床", "复牌", "停牌", "回购", "增持", "股权", "实控人", "注入",
)
#: Keywords of the concepts.
CONCEPT_KEYWORDS = {
    "AI": ("人工智能", "AI", "大模型", "算力", "机器人", "智能体", "AIGC"),
    "半导体": ("半导体", "芯片", "集成电路", "晶圆", "封测", "光刻"),
    "新能源车": ("新能源汽车", "新能源车", "电动车", "智能驾驶", "汽车", "车企"),
    "锂电池": ("锂电", "电池", "动力电池", "固态电池", "储能电池"),
    "光伏": ("光伏", "硅片", "组件", "逆变器", "太阳能"),
    "储能": ("储能", "新型储能", "电网侧", "电力系统"),
    "低空经济": ("低空经济", "eVTOL", "飞行汽车", "无人机"),
    "机器人": ("机器人", "人形机器人", "工业机器人", "减速器"),
    "医药": ("医药", "创新药", "医疗", "生物医药", "药企", "CXO"),
    "银行": ("银行", "贷款", "存款", "息差", "信贷"),
    "证券": ("证券", "券商", "资本市场", "投行", "两融"),
    "保险": ("保险", "保费", "险资", "寿险", "财险"),
    "房地产": ("房地产", "地产", "楼市", "房企", "商品房"),
    "消费": ("消费", "零售", "食品饮料", "白酒", "旅游", "餐饮"),
    "军工": ("军工", "航空发动机", "导弹", "卫星", "国防"),
    "煤炭": ("煤炭", "煤价", "焦煤", "焦炭"),
    "有色金属": ("有色", "铜", "铝", "黄金", "稀土", "金属"),
    "化工": ("化工", "化肥", "磷化工", "煤化工", "纯碱"),
    "数字经济": ("数字经济", "数据要素", "云计算", "信创", "软件"),
    "一带一路": ("一带一路", "出海", "海外订单", "外贸", "出口"),
}


def related_concepts(title: Column, summary: Column, concepts: Mapping[str, Sequence[str]] = CONCEPT_KEYWORDS) -> Column:
    """Names of the concepts whose keywords occur, by 3 x title + summary occurrences, ties by name; ten at most."""
    scored = []
    for name, words in concepts.items():
        score = F.lit(0)
        for w in words:
            score = score + 3 * occurrences(title, w) + occurrences(summary, w)
        scored.append(F.struct((-score).alias("score"), F.lit(name).alias("name")))
    found = F.array_sort(F.filter(F.array(*scored), lambda s: s["score"] < 0))
    return F.slice(F.transform(found, lambda s: s["name"]), 1, MOST_CONCEPTS)


def with_concepts(news: DataFrame, concepts: Mapping[str, Sequence[str]] = CONCEPT_KEYWORDS) -> DataFrame:
    return news.withColumn("concepts", related_concepts(F.col("title"), F.col("summary"), concepts))


def concept_heat(news: DataFrame) -> DataFrame:
    """concept and its share of all news rows; a row counts a concept once."""
    total = news.agg(F.count("*").alias("total"))
    each = news.select(F.explode(F.array_distinct(F.slice("concepts", 1, MOST_CONCEPTS))).alias("concept")).where("concept <> ''")
    return each.groupBy("concept").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("concept", (F.col("n") / F.col("total")).alias("heat"))


def with_concept_heat(news: DataFrame) -> DataFrame:
    """concept_heat (array of concept and heat) and a new content_hash for each row; the heat table has a row for each concept."""
    heat = concept_heat(news).agg(F.map_from_entries(F.collect_list(F.struct("concept", "heat"))).alias("heats"))
    pairs = F.transform(F.slice("concepts", 1, MOST_CONCEPTS), lambda c: F.struct(c.alias("concept"), F.coalesce(F.col("heats")[c], F.lit(0.0)).alias("heat")))
    out = news.crossJoin(F.broadcast(heat)).withColumn("concept_heat", pairs).drop("heats")
    return out.withColumn("content_hash", joined_hash(*[F.col(c) for c in ("news_link", "title", "summary", "source_name", "publish_time", "credibility_level", "heat")], F.to_json("concepts"), F.to_json("concept_heat")))


def merged_heat(news: DataFrame) -> DataFrame:
    """The greatest heat that any row stores for a concept."""
    return news.select(F.explode("concept_heat").alias("h")).groupBy(F.col("h.concept").alias("concept")).agg(F.max("h.heat").alias("heat"))


def match_score(name: Column, text: Column, keywords: Column) -> Column:
    """1.0 if the text names the stock, 0.15 for each of the concept's keywords in it; 1.0 at most."""
    named = F.when((F.length(name) > 0) & F.contains(text, name), 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.aggregate(keywords, named, lambda a, k: a + F.when(F.contains(text, k), 0.15).otherwise(0.0)))


def stock_scores(news: DataFrame, stocks: DataFrame, heat: DataFrame, concepts: Mapping[str, Sequence[str]] = CONCEPT_KEYWORDS) -> DataFrame:
    """scode, news_score and hot_concepts (the three highest).

    A concept's keywords count alike for every stock, so a row's keyword part is computed once and summed by concept. Only rows that name a
    stock differ: the names in a text are found in one scan of it, and the difference that a name makes is added to the stock.
    """
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(k) for k in x]) for pair in concepts.items() for x in pair])
    heats = heat.agg(F.map_from_entries(F.collect_list(F.struct("concept", "heat"))).alias("heats"))  # a row for each concept
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    told = news.select(text.alias("text"), "heat", "credibility_level", "concepts").crossJoin(F.broadcast(heats))
    grade = (11 - F.col("credibility_level")) / 10 * (1 + F.least(F.coalesce("heat", F.lit(0)), F.lit(100000)) / 100000)

    def part(concept: Column, rank: Column) -> Column:
        weight = F.col("heats")[concept] * (MOST_CONCEPTS - rank) / MOST_CONCEPTS * grade
        return F.struct(concept.alias("concept"), weight.alias("weight"), match_score(F.lit(""), F.col("text"), F.coalesce(table[concept], F.array().cast("array<string>"))).alias("plain"))

    told = told.select("text", F.filter(F.transform(F.slice("concepts", 1, MOST_CONCEPTS), part), lambda p: p["weight"].isNotNull()).alias("parts")).where(F.size("parts") > 0)
    common = told.select(F.explode("parts").alias("p")).groupBy(F.col("p.concept").alias("concept")).agg(F.sum(F.col("p.weight") * F.col("p.plain")).alias("common"))
    named = stock_mentions(told, stocks, codes=False).select("scode", F.explode("parts").alias("p"))
    hits = named.groupBy("scode", F.col("p.concept").alias("concept")).agg(F.sum(F.col("p.weight") * (1 - F.col("p.plain"))).alias("more"))
    every = stocks.select("scode").crossJoin(F.broadcast(common))  # a row for each concept
    scored = every.join(hits, ["scode", "concept"], "left").select("scode", "concept", (F.col("common") + F.coalesce("more", F.lit(0.0))).alias("score")).where("score > 0")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("concept"))))
    return scored.groupBy("scode").agg(F.sum("score").alias("news_score"), F.array_join(F.slice(F.transform(ordered, lambda x: x["concept"]), 1, 3), ",").alias("hot_concepts"))


def news_hot(scores: DataFrame, performance: DataFrame, least: int = 3, most: int = 5, news_weight: float = 0.65) -> DataFrame:
    """The day's best by news and performance: max(least, min(most, n)) rows."""
    joined = scores.join(performance, "scode", "left").withColumn("score", news_weight * F.col("news_score") + (1 - news_weight) * F.coalesce("performance", F.lit(0.0)))
    # of n rows, max(least, min(most, n)): as a limit, that is the greater of the two
    return joined.orderBy(F.desc("score"), "scode").limit(max(least, most)).withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("score"), "scode")))


def news_rows(raw: DataFrame, source: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows of any source as news rows: columns maps title, summary, news_link, publish_time and heat to the source's names; blank links go."""
    def of(name: str) -> Column:
        return F.col(columns[name]).cast("string") if columns.get(name) in raw.columns else F.lit(None).cast("string")

    out = raw.select(F.trim(of("news_link")).alias("news_link"), clean_text(of("title")).alias("title"), clean_text(of("summary")).alias("summary"), F.lit(source).alias("source_name"),
                     of("publish_time").alias("publish_time"), F.lit(CREDIBILITY.get(source, 5)).alias("credibility_level"), parse_heat(of("heat")).alias("heat"))
    return out.where("news_link <> ''")


def crawl(sources: Sequence[DataFrame], limit: int = 0) -> DataFrame:
    """Union of sources, the latest row of each link, latest and hottest first; limit 0 takes all."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    w = Window.partitionBy("news_link").orderBy(F.desc_nulls_last("publish_time"), F.desc_nulls_last("heat"), "title")
    out = out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(F.desc_nulls_last("publish_time"), F.desc_nulls_last("heat"), "news_link")
    return out.limit(limit) if limit > 0 else out


def crawl_sources(sources: Mapping[str, Callable[[], DataFrame]], limit: int = 0, concepts: Mapping[str, Sequence[str]] = CONCEPT_KEYWORDS) -> tuple[DataFrame, dict[str, str]]:
    """(news, failures) of named sources, each a function that gives news rows and may fail, at once or when it is read.

    A failing source is left out and its error told by name. Of a link the row of the first source stays, there the latest and hottest; latest first, `limit` rows
    if it is not 0. Concepts and their heat among these rows are attached. Without any source there is no row.
    """
    failures, found = {}, []
    for place, (name, source) in enumerate(sources.items()):
        try:
            found.append(stored(source(), "source").withColumn("__source", F.lit(place)))
        except Exception as error:  # whatever a source raises, the others go on
            failures[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    if not found:
        raise ValueError(f"no source could be read: {failures}")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    w = Window.partitionBy("news_link").orderBy("__source", F.desc_nulls_last("publish_time"), F.desc_nulls_last("heat"), "title")
    rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__source")
    order = [F.desc_nulls_last("publish_time"), F.desc_nulls_last("heat"), F.col("news_link")]
    kept = rows.orderBy(*order).limit(limit) if limit > 0 else rows
    return with_concept_heat(with_concepts(kept, concepts)).orderBy(*order), failures


def stored_concepts(c: Column) -> Column:
    return F.slice(json_strings(c), 1, MOST_CONCEPTS)
