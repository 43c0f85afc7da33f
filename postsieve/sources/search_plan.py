"""The search plan: platforms, their keywords and their search URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.text import encode_component

# Platforms with their keywords, in crawl order. ``url`` is the search
# URL up to the encoded keyword, ``filters`` what follows it, ending in the name of
# the page parameter; ``step`` is the offset per page, null where pages are numbered.
# ``window_days`` and ``levels`` are the recency and seniority limits those URLs carry.
PLATFORMS = [
    {
        "name": "LinkedIn",
        "host_mark": "linkedin",
        "url": "https://www.linkedin.com/jobs/search/?keywords=",
        "filters": "&f_E=1%2C2&f_TPR=r7776000&start=",
        "step": 25,
        "window_days": 90,
        "levels": ["1", "2"],
        "keywords": [
            "AI Engineer intern",
            "AI Engineer new graduate",
            "LLM Engineer intern",
            "LLM Engineer new grad",
            "Generative AI Engineer intern",
            "AIGC Engineer new grad",
            "Machine Learning Engineer intern",
            "Machine Learning Engineer new college grad",
            "ML Engineer entry level",
            "Applied ML Engineer intern",
            "Deep Learning Engineer intern",
            "NLP Engineer intern",
            "Computer Vision Engineer intern",
            "CV Engineer new grad",
            "Algorithm Engineer intern",
            "Data Intelligence Engineer intern",
            "Recommendation System Engineer intern",
            "MLOps Engineer intern",
            "AI Platform Engineer new grad",
            "AI Research Engineer intern",
        ],
    },
    {
        "name": "Indeed",
        "host_mark": "indeed.com",
        "url": "https://www.indeed.com/jobs?q=",
        "filters": "&fromage=90&start=",
        "step": 10,
        "window_days": 90,
        "levels": [],
        "keywords": [
            "AI Engineer intern",
            "AI Engineer new grad",
            "LLM Engineer intern",
            "Generative AI intern",
            "AIGC Engineer entry level",
            "Machine Learning Engineer intern",
            "ML Engineer new grad",
            "Applied Machine Learning intern",
            "Machine Learning entry level",
            "Deep Learning Engineer intern",
            "NLP Engineer intern",
            "NLP Engineer new grad",
            "Computer Vision Engineer intern",
            "Algorithm Engineer intern",
            "Data Scientist Machine Learning intern",
            "Data Intelligence intern",
            "Recommendation Algorithm intern",
            "MLOps intern",
            "AI Research intern",
            "Applied AI Engineer entry level",
        ],
    },
    {
        "name": "Boss直聘",
        "host_mark": "zhipin.com",
        "url": "https://www.zhipin.com/web/geek/job?query=",
        "filters": "&city=100010000&publishTime=3&experience=101%2C102&page=",
        "step": None,
        "window_days": 30,
        "levels": ["101", "102"],
        "keywords": [
            "AI工程师 校招",
            "AI工程师 实习",
            "LLM工程师 校招",
            "大模型工程师 校招",
            "大模型工程师 实习",
            "AIGC工程师 校招",
            "生成式AI工程师 校招",
            "机器学习工程师 校招",
            "机器学习工程师 实习",
            "深度学习工程师 校招",
            "深度学习工程师 实习",
            "NLP工程师 校招",
            "NLP工程师 实习",
            "自然语言处理工程师 校招",
            "计算机视觉工程师 校招",
            "计算机视觉工程师 实习",
            "推荐算法工程师 校招",
            "推荐系统工程师 实习",
            "算法工程师 校招",
            "算法工程师 实习",
            "数据智能工程师 校招",
            "搜索算法工程师 校招",
            "AI平台工程师 校招",
            "MLOps工程师 校招",
        ],
    },
]

NAMES = [p["name"] for p in PLATFORMS]


def platform_dim(spark: SparkSession) -> DataFrame:
    """``(platform_idx, platform)``: one row per platform, small by definition."""
    return spark.createDataFrame(list(enumerate(NAMES)), "platform_idx int, platform string")


def search_plan(spark: SparkSession) -> DataFrame:
    """``(platform_idx, platform, keyword_idx, keyword)`` in crawl order."""
    rows = [(i, p["name"], p["keywords"]) for i, p in enumerate(PLATFORMS)]
    dim = spark.createDataFrame(rows, "platform_idx int, platform string, keywords array<string>")
    return dim.select("platform_idx", "platform", F.posexplode("keywords").alias("keyword_idx", "keyword"))


def select_platforms(plan: DataFrame, indices: list[int] | None = None) -> DataFrame:
    """Chosen platforms only; ``platform_pos`` is their place in the list given."""
    chosen = [0, 1, 2] if indices is None else list(indices)
    order = F.array(*[F.lit(i) for i in chosen]).cast("array<int>")
    return plan.filter(F.col("platform_idx").isin(chosen)).withColumn(
        "platform_pos", (F.array_position(order, F.col("platform_idx")) - 1).cast("int")
    )


def toggle_platform(chosen: Column, idx: Column) -> Column:
    """Remove ``idx`` from the list if it is there, else add it and sort."""
    return F.when(F.array_contains(chosen, idx), F.array_remove(chosen, idx)).otherwise(
        F.array_sort(F.array_append(chosen, idx))
    )


def expand_plan(plan: DataFrame, max_pages: int = 10) -> DataFrame:
    """One row per keyword and page, pages counted from 1."""
    return plan.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))


def _per_platform(platform_idx: Column, of) -> Column:
    """A column chosen by platform, in the order of ``PLATFORMS``."""
    chosen = F.lit(None).cast("string")
    for i, p in reversed(list(enumerate(PLATFORMS))):
        chosen = F.when(platform_idx == i, of(p)).otherwise(chosen)
    return chosen


def search_urls(plan: DataFrame, max_pages: int = 10) -> DataFrame:
    """The expanded plan with ``search_url``.

    Keywords are encoded before the pages are expanded, once each.
    """
    idx, page = F.col("platform_idx"), F.col("page_no")
    head = _per_platform(idx, lambda p: F.concat(F.lit(p["url"]), F.col("_encoded"), F.lit(p["filters"])))
    heads = plan.withColumn("_encoded", encode_component(F.col("keyword"))).withColumn("_head", head)
    place = _per_platform(idx, lambda p: (page if p["step"] is None else (page - 1) * p["step"]).cast("string"))
    pages = expand_plan(heads, max_pages)
    return pages.withColumn("search_url", F.concat("_head", place)).drop("_encoded", "_head")
