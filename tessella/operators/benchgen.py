"""A seeded generator of tool-calling cases: categories by plan, languages in turn, arguments from pools, distractor
tools, new ids after a shuffle. Every pick is the md5 of the seed, the case and what is picked, so that any engine
with md5 gives the same cases."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.sampling import numbered

#: Cases of each category.
PLAN = {"single_tool": 50, "parallel_same": 40, "multi_tool_choice": 40, "parallel_different": 30, "multi_argument": 40, "no_tool": 30, "wrong_tool_trap": 30, "distractor": 20}
#: A small set of other categories, for checks of an evaluation itself.
FIXTURE = {"single_tool": 6, "multi_tool_choice": 5, "argument_filling": 5, "no_tool": 5, "wrong_tool_trap": 5, "multi_argument": 5, "parallel_calls": 5}
#: Tools that stand beside those a case needs.
BESIDE = {"distractor": 6, "multi_tool_choice": 3, "wrong_tool_trap": 3, "argument_filling": 1}
LANGUAGES = ("zh", "en")
POOLS = {
    "city": {"en": ["Oslo", "Lima", "Cairo", "Quito", "Perth", "Turin", "Accra", "Osaka"], "zh": ["北京", "上海", "广州", "成都", "杭州", "西安", "南京", "青岛"]},
    "day": {"en": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"], "zh": ["周一", "周二", "周三", "周四", "周五"]},
    "topic": {"en": ["the rent", "my exam", "the garden", "a birthday", "the dentist"], "zh": ["房租", "考试", "花园", "生日", "牙医"]},
    "genre": {"en": ["jazz", "folk", "opera", "techno"], "zh": ["爵士", "民谣", "歌剧", "电子乐"]},
    "item": {"en": ["lentils", "a lamp", "rice", "a kettle", "plums"], "zh": ["扁豆", "台灯", "大米", "水壶", "李子"]},
    "language": {"en": ["French", "Thai", "Polish"], "zh": ["法语", "泰语", "波兰语"]},
    "count": {"en": ["2", "3", "4", "5", "7"], "zh": ["2", "3", "4", "5", "7"]},
}
#: intent: tool, its arguments and their pools, and a short (one argument) and a long question in each language.
INTENTS = {
    "weather": ("get_weather", [("city", "city"), ("day", "day")], {"en": ("How is the weather in {0}?", "How is the weather in {0} on {1}?"), "zh": ("{0}天气怎么样？", "{0}{1}天气怎么样？")}),
    "hotel": ("find_hotels", [("city", "city"), ("nights", "count")], {"en": ("Find a hotel in {0}.", "Find a hotel in {0} for {1} nights."), "zh": ("在{0}找酒店。", "在{0}找住{1}晚的酒店。")}),
    "train": ("find_trains", [("origin", "city"), ("day", "day"), ("seats", "count")], {"en": ("Which trains leave {0}?", "Which trains leave {0} on {1} with {2} seats?"), "zh": ("{0}出发有哪些火车？", "{1}从{0}出发、有{2}个座位的火车有哪些？")}),
    "map": ("show_map", [("place", "city"), ("zoom", "count")], {"en": ("Show {0} on a map.", "Show {0} on a map at zoom {1}."), "zh": ("显示{0}的地图。", "以{1}倍显示{0}的地图。")}),
    "reminder": ("set_reminder", [("about", "topic"), ("day", "day")], {"en": ("Remind me of {0}.", "Remind me of {0} on {1}."), "zh": ("提醒我{0}的事。", "{1}提醒我{0}的事。")}),
    "note": ("save_note", [("about", "topic"), ("copies", "count")], {"en": ("Make a note on {0}.", "Make a note on {0} in {1} copies."), "zh": ("记一条{0}的笔记。", "记{1}份{0}的笔记。")}),
    "music": ("play_music", [("genre", "genre"), ("songs", "count")], {"en": ("Play some {0}.", "Play {1} songs of {0}."), "zh": ("放点{0}。", "放{1}首{0}。")}),
    "news": ("get_news", [("about", "topic"), ("limit", "count")], {"en": ("Any news on {0}?", "Give me {1} news on {0}."), "zh": ("有{0}的新闻吗？", "给我{1}条{0}的新闻。")}),
    "shop": ("search_shop", [("item", "item"), ("limit", "count")], {"en": ("Where can I buy {0}?", "List {1} offers for {0}."), "zh": ("哪里能买{0}？", "列出{1}个{0}的报价。")}),
    "recipe": ("find_recipe", [("with", "item"), ("servings", "count"), ("day", "day")], {"en": ("A recipe with {0}, please.", "A recipe with {0} for {1} on {2}, please."), "zh": ("用{0}做什么菜？", "{2}用{0}做{1}人份的菜。")}),
    "translate": ("translate_text", [("text", "topic"), ("language", "language")], {"en": ("Translate '{0}'.", "Translate '{0}' into {1}."), "zh": ("翻译“{0}”。", "把“{0}”翻译成{1}。")}),
    "air": ("get_air_quality", [("city", "city"), ("day", "day")], {"en": ("Is the air in {0} clean?", "Is the air in {0} clean on {1}?"), "zh": ("{0}空气好吗？", "{0}{1}空气好吗？")}),
}
CHAT = {"en": "Thank you, that is all about {0}.", "zh": "谢谢，{0}的事就这些。"}


def definition(intent: str) -> str:
    tool, arguments, _ = INTENTS[intent]
    properties = {name: {"type": "string", "description": f"{name} ({pool})"} for name, pool in arguments}
    return json.dumps({"type": "function", "function": {"name": tool, "description": f"Answers about {intent}", "parameters": {"type": "object", "properties": properties, "required": [arguments[0][0]]}}})


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def generate(spark: SparkSession, seed: int = 42, plan: dict[str, int] | None = None) -> DataFrame:
    """id, category, language, messages, tools, expect: as many cases as the plan says, in shuffled order."""
    plan = plan or PLAN
    names = list(INTENTS)
    rows = spark.createDataFrame(list(plan.items()), "category string, n int").select("category", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    rows = rows.withColumn("language", F.when(F.col("i") % 2 == 0, LANGUAGES[0]).otherwise(LANGUAGES[1]))

    def digest(*what) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), "category", F.col("i").cast("string"), *what).cast("binary"))

    def pick(n: int, *what) -> Column:
        return F.pmod(F.conv(F.substring(digest(*what), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")

    a = pick(len(names), F.lit("intent"))
    rows = rows.withColumn("a", a).withColumn("b", (F.col("a") + 1 + pick(len(names) - 1, F.lit("other"))) % len(names))
    # Picks are made once, so that the questions and calls of all intents only look them up.
    places = max(len(arguments) for _, arguments, _ in INTENTS.values())
    rows = rows.withColumns({f"at{place}_{n}": pick(n, F.lit(f"value{place}")) for place in range(places) for n in {len(x["en"]) for x in POOLS.values()}})
    rows = rows.withColumns({f"pool_{name}": F.when(F.col("language") == "zh", _array(pool["zh"])).otherwise(_array(pool["en"])) for name, pool in POOLS.items()})
    kind = F.col("category")
    same, different, silent = kind == "parallel_same", kind.isin("parallel_different", "parallel_calls"), kind.isin("no_tool", "wrong_tool_trap")
    many = kind.isin("multi_argument", "argument_filling")

    def value(intent: str, place: int, again: int) -> Column:
        """The argument at a place; the second of two calls takes the value after that of the first."""
        pool = INTENTS[intent][1][place][1]
        n = len(POOLS[pool]["en"])
        return F.get(F.col(f"pool_{pool}"), (F.col(f"at{place}_{n}") + again) % n)

    def by_intent(which: str, make) -> Column:
        out = F.lit(None)
        for k, name in enumerate(names):
            out = F.when(F.col(which) == k, make(name)).otherwise(out)
        return out

    def question(again: int):
        def make(intent: str) -> Column:
            _, arguments, texts = INTENTS[intent]
            text = lambda lang: F.when(many, texts[lang][1]).otherwise(texts[lang][0])
            out = F.when(F.col("language") == "zh", text("zh")).otherwise(text("en"))
            for place in range(len(arguments)):
                out = F.replace(out, F.lit("{%d}" % place), value(intent, place, again))
            return out

        return make

    def call(again: int):
        def make(intent: str) -> Column:
            tool, arguments, _ = INTENTS[intent]
            one = lambda place: F.concat(F.lit(f'"{arguments[place][0]}": "'), value(intent, place, again), F.lit('"'))
            every = F.concat_ws(", ", *map(one, range(len(arguments))))
            return F.struct(F.lit(tool).alias("name"), F.concat(F.lit("{"), F.when(many, every).otherwise(one(0)), F.lit("}")).alias("arguments"))

        return make

    chat = F.when(F.col("language") == "zh", CHAT["zh"]).otherwise(CHAT["en"])
    chat = F.replace(chat, F.lit("{0}"), F.get("pool_topic", F.col(f"at0_{len(POOLS['topic']['en'])}")))
    first, again, other = by_intent("a", question(0)), by_intent("a", question(1)), by_intent("b", question(1))
    content = F.when(kind == "no_tool", chat).when(same, F.concat_ws(" ", first, again)).when(different, F.concat_ws(" ", first, other)).otherwise(first)
    none = F.array().cast("array<struct<name: string, arguments: string>>")
    one = by_intent("a", call(0))
    calls = F.when(silent, none).when(same, F.array(one, by_intent("a", call(1)))).when(different, F.array(one, by_intent("b", call(1)))).otherwise(F.array(one))
    spec = _array([definition(k) for k in names])
    beside = F.lit(0)
    for name, n in BESIDE.items():
        beside = F.when(kind == name, n).otherwise(beside)
    order = F.array_sort(F.array(*(F.struct(digest(F.lit(f"beside{k}")).alias("p"), F.lit(k).alias("k")) for k in range(len(names)))))
    free = F.filter(order, lambda x: (x["k"] != F.col("a")) & ~(different & (x["k"] == F.col("b"))))
    own = F.when(silent, F.array().cast("array<int>")).when(different, F.array("a", "b")).otherwise(F.array("a"))
    which = F.concat(own, F.transform(F.slice(free, 1, beside), lambda x: x["k"]))
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content"), none.alias("tool_calls"), F.lit(None).cast("string").alias("name")))
    message = F.transform(message, lambda m: m.withField("tool_calls", F.lit(None).cast("array<struct<name: string, arguments: string>>")))
    rows = rows.select(F.concat_ws("-", "category", "i").alias("key"), "category", "language", message.alias("messages"), F.transform(which, lambda k: F.get(spec, k)).alias("tools"), F.struct(F.when(silent, "no_tool").otherwise("tool").alias("mode"), calls.alias("calls")).alias("expect"))
    rows = numbered(rows, seed, "key")
    return rows.select(F.concat(F.lit("case-"), F.lpad(F.col("rk").cast("string"), 4, "0")).alias("id"), "category", "language", "messages", "tools", "expect")


def invariants(cases: DataFrame, required: list[str]) -> DataFrame:
    """One row: n, whether ids are unique and none is null, the required categories that are missing, and cases whose
    expected calls don't fit their mode or that don't begin with a user."""
    begins = F.coalesce(F.get("messages", F.lit(0))["role"] == "user", F.lit(False))
    fits = F.when(F.col("expect.mode") == "tool", F.size("expect.calls") > 0).otherwise(F.size("expect.calls") <= 0)
    return cases.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("id") == F.count(F.lit(1))).alias("unique_ids"),
        F.array_sort(F.array_except(_array(required) if required else F.array().cast("array<string>"), F.collect_set("category"))).alias("missing"),
        F.count_if(~F.coalesce(begins & fits, F.lit(False))).alias("n_unfit"),
    )


def category_counts(cases: DataFrame) -> DataFrame:
    """category, n, in the order of the names."""
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")
