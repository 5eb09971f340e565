"""Ordered rule lists as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations of the note format.
REQUIRED_FIELDS = ["title", "created", "updated", "type", "tags", "status", "audience"]
STATUSES = ["draft", "stable", "archived", "active", "completed"]
TYPES = ["standards", "cheatsheet", "rules", "source-notes", "daily", "project", "moc", "notes", "inbox", "draft"]
AUDIENCES = ["agent", "human", "both", "architect", "developer"]
TAG_NAMESPACES = ["lang", "category", "topic", "source", "status", "project"]
AUTHORITIES = ["official", "primary", "secondary", "community", "synthetic", "unknown"]
CLAIM_RISKS = ["none", "low", "medium", "high"]
REVIEW_STATUSES = ["unreviewed", "reviewed"]
CLAIM_PREFIXES = ["必须", "禁止", "不得", "应", "推荐", "MUST", "SHOULD", "NEVER", "is ", "is not"]
POSITIVE = "一定要|必须|应当|推荐|正确|(?<![A-Za-z])always(?![A-Za-z])|(?<![A-Za-z])must(?!\\s*not)(?![A-Za-z])|(?<![A-Za-z])should(?![A-Za-z])"
NEGATIVE = "不能|不应|不得|不要|禁止|切勿|(?<![A-Za-z])must\\s+not(?![A-Za-z])|(?<![A-Za-z])never(?![A-Za-z])|(?<![是能与])否(?!则)"
MARKERS = "(?i)一定要|必须|应当|推荐|正确|不能|不应|不得|不要|禁止|切勿|(?<![A-Za-z])must\\s+not(?![A-Za-z])|(?<![A-Za-z])always(?![A-Za-z])|(?<![A-Za-z])must(?![A-Za-z])|(?<![A-Za-z])should(?![A-Za-z])|(?<![A-Za-z])never(?![A-Za-z])"
ENGLISH_STOPS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "by", "is", "are", "was", "were", "be", "been", "for", "with", "when", "if", "then",
    "this", "that", "it", "its", "as", "we", "you", "they", "he", "she", "can", "could", "will", "would", "do", "does", "did", "have", "has", "had", "not", "no",
    "so", "such", "than", "there", "their", "from",
]
CJK_STOPS = [
    "我们", "你们", "他们", "它们", "这个", "那个", "一个", "一些", "一下", "什么", "怎么", "如何", "如果", "那么", "因为", "所以", "但是", "然后", "或者", "以及", "并且", "其中", "其他",
    "所有", "任何", "时候", "情况", "进行", "使用", "可以", "就是", "还是", "也是", "都是", "不是", "没有", "能够", "需要", "应该", "注意", "建议", "这里", "那里", "哪些", "以下", "如下",
    "上面", "下面", "相关", "问题", "方法", "方式", "内容", "笔记", "文章", "文档", "说明", "描述", "介绍", "总结", "记录", "整理", "设置", "配置", "支持", "默认", "当前", "系统", "数据",
    "代码", "测试", "运行", "执行", "处理", "返回", "参数", "函数", "变量", "类型", "来源", "参考", "出自", "来自", "一定",
]
DIRECTORY_TRUST = [
    ("06-Sources/Books/", "primary", "medium"),
    ("06-Sources/Papers/", "primary", "medium"),
    ("01-Rules/", "synthetic", "high"),
    ("00-MOC/", "synthetic", "none"),
    ("08-Projects/", "synthetic", "medium"),
    ("09-Career/", "synthetic", "medium"),
    ("04-Systems/", "synthetic", "medium"),
    ("05-Tools/", "synthetic", "medium"),
    ("10-Daily/", "unknown", "none"),
    ("99-Inbox/", "unknown", "none"),
]
CREDENTIAL_NAMES = ["key", "token", "password", "secret", "sign", "sig", "api_key", "apikey", "access_token", "client_secret", "credential", "auth", "key_id"]
TRUSTED_HOSTS = ["fonts.googleapis.com", "fonts.gstatic.com"]


def choose(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def polarity(clause: Column) -> Column:
    """negative before positive; null for neither."""
    return choose([(clause.rlike(NEGATIVE), "negative"), (clause.rlike(POSITIVE), "positive")])


def trust(rel: Column, type_: Column, title: Column, tags: Column, source_type: Column, source_author: Column) -> Column:
    """(authority, claim_risk) of a note by its fields and place, first rule first."""
    pair = lambda a, r: F.struct(F.lit(a).alias("authority"), F.lit(r).alias("claim_risk"))
    under = {d: (rel.startswith(d), pair(a, r)) for d, a, r in DIRECTORY_TRUST}
    name = F.substring_index(rel, "/", -1)
    articles = rel.startswith("06-Sources/Articles/")
    index = title.contains("索引") | F.coalesce(F.array_contains(tags, "category/moc"), F.lit(False))
    languages = rel.startswith("03-Languages/")
    moc = under["00-MOC/"][0] | (name == "README.md") | F.coalesce(type_ == "moc", F.lit(False))
    cases = [
        ((source_type == "article") & (F.length(source_author) > 0), pair("community", "low")),
        under["06-Sources/Books/"], under["06-Sources/Papers/"],
        (articles & index, pair("secondary", "low")), (articles, pair("secondary", "medium")),
        (languages & rel.endswith("-CHEATSHEET.md"), pair("synthetic", "low")), (languages & rel.endswith("-STANDARDS.md"), pair("synthetic", "high")),
        under["01-Rules/"], (moc, pair("synthetic", "none")),
        *[under[d] for d in ("08-Projects/", "09-Career/", "04-Systems/", "05-Tools/", "10-Daily/", "99-Inbox/")],
    ]
    return choose(cases, pair("unknown", "none"))


def is_claim(line: Column) -> Column:
    """Whether a line, without list, quote and heading marks, begins like a normative statement."""
    bare = F.regexp_replace(line, "^(?:[>\\s#*`\\-]|\\d+[.)\\]])+", "")
    out = F.lit(False)
    for p in CLAIM_PREFIXES:
        out = out | bare.startswith(p)
    return out


def age_tier(days: Column) -> Column:
    d = F.greatest(days, F.lit(0))
    return choose([(d >= 30, ">=30d"), (d >= 14, ">=14d"), (d >= 7, ">=7d")], "<7d")


def duplicate_advice(ratio: Column) -> Column:
    return choose([(ratio >= 0.95, "delete"), (ratio >= 0.85, "merge"), (ratio >= 0.70, "review")])


def heat(count: Column) -> Column:
    return choose([(count <= 0, 0), (count <= 1, 1), (count <= 3, 2), (count <= 6, 3)], 4)


def streak_badge(days: Column) -> Column:
    return choose([(days >= 100, 100), (days >= 30, 30), (days >= 7, 7), (days >= 1, 1)], 0)


def value_score(base: Column, text: Column, keywords: list[str]) -> Column:
    """How much a comment is worth keeping, in [0, 1]: length, keywords, and CJK explanation."""
    n = F.length(text)
    hits = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), k)))
    size = choose([(n >= 80, 0.12), (n >= 40, 0.06), (n < 15, -0.10)], 0.0)
    score = base + size + F.least(hits * 0.04, F.lit(0.15)) + F.when(text.rlike("[\\u4e00-\\u9fa5]"), 0.05).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def fate(path: Column, rules: list[tuple[str, list[str]]], otherwise: str = "exclude") -> Column:
    """What happens to a path by ordered lists of globs."""

    def pattern(glob: str) -> str:
        out, special = "", set(".^$+(){}[]|\\")
        for piece in glob.replace("**", "\0"):
            out += ".*" if piece == "\0" else "[^/]*" if piece == "*" else "[^/]" if piece == "?" else f"\\{piece}" if piece in special else piece
        return f"^{out}$"

    return choose([(path.rlike("|".join(map(pattern, globs))), name) for name, globs in rules], otherwise)
