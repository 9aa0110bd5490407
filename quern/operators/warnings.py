"""Allergen warnings from the lines of a label.

A warning begins at its opening words, goes on over the next lines while its sentence is
open (lines of amounts between them are passed over), and ends at the next field, at the
first clause that is about something else, or behind the last word that such warnings
end with.  A label's longest warning counts, the first of equal ones.

Lines that go on are known from their neighbour alone, so all labels' lines are read in
one pass with a window by label; a warning has MOST_LINES lines at most, as on labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allergens, opening words, words that a warning must or must not hold, fields that may follow, words that end it, units.
ALLERGENS = "麩質 穀物 小麥 牛奶 羊奶 奶類 乳製品 乳品 大豆 黃豆 蛋 花生 堅果 芝麻 魚 甲殼 螺貝 芒果 蠶豆 蚕豆 蝦 蟹 奇異果 亞硫酸 阿斯巴甜 種子 葵花 乾酪素 杏仁 腰果 核桃 松子".split()
SUBJECTS, LINES_OF = ["本產品含", "本商品含", "本品含"], ["生產線", "產線", "生產設備"]
OPENINGS = ["過敏原", "含過敏", "含有過敏", "本產品生產設備", "本產品生產製程", "本產品生產線", "苯酮尿症", "含有小麥"]
ABOUT = ["過敏", "生產線", "產線", "生產設備", "苯酮尿症", "不適合", "不宜", *ALLERGENS]
NOT_ABOUT = "沉澱 搖勻 飲用前 殺菌 表面 結晶 請安心 微波 加熱 開封 咖啡因 自然現象 請先 保存 冷藏 室溫".split()
FIELDS_BEHIND = (
    "殺菌方式 保存方式 保存條件 保存期限 賞味期限 有效日期 製造日期 內容量 净重 淨重 重量 容量 規格 品名 商品名稱 成分 原料 原材料 配料 營養標示 营养标示 每一份量 注意事項 食用方法 沖泡方式 烹調方式 "
    "產地 原產地 原料來源 廠商 地址 電話 服務 條碼 產品統一編號"
).split()
MAKER_ENDS = ["股份有限公司", "有限公司", "企業社", "工業股份"]
FIELDS_AHEAD = (
    "品名 商品名稱 內容量 淨重 净重 重量 容量 規格 成分 原料 原材料 配料 營養標示 每一份量 本包裝含 熱量 蛋白質 脂肪 碳水化合物 鈉 有效日期 保存期限 保存方式 保存條件 賞味期限 製造日期 "
    "製造商 製造廠 委託 受託 進口商 販賣商 負責廠商 地址 電話 服務 原產地 產地 注意事項 食用方法 沖泡 微波 家用 烹調 加熱 品質 產品統一編號 條碼 退貨 投保 素食 殺菌"
).split()
ENDINGS = ["及其製品", "等製品", "的產品", "相關產品", "製品", "成分", "食用", "留意", "飲用", *ALLERGENS]
UNITS = "公克 毫克 公絲 微克 公升 毫升 大卡 千卡 千焦 kcal kJ".split()
HEADINGS = ["過敏原資訊", "過敏原標示", "過敏原標記", "過敏原提示", "過敏原"]
MOST_LINES, LEAST = 4, 6

MARK = r"[※*●]"
either = "|".join
BARE = rf"^\s*{MARK}?\s*含(?=[^。；;]{{0,16}}(?:{either(ALLERGENS)}))"  # only at a line's begin: within a list of ingredients it says nothing
THEIRS = rf"(?:該|本|此)\s*(?:{either(LINES_OF)})"
OPENING = rf"{either(OPENINGS)}|{MARK}?\s*(?:{either(SUBJECTS)})|{BARE}|{THEIRS}\s*[亦也]\s*生產"
AMOUNTS = rf"(?i)^[\d\s.,、%()（）]*(?:(?:{either(UNITS)}|mg|ml|g|%)[\d\s.,、%()（）]*)+$"
FIELD = rf"(?:{either(FIELDS_BEHIND)})[：:]|品\s*質|{either(MAKER_ENDS)}"
HEADED = rf"^\s*{MARK}?\s*(?:{either(FIELDS_AHEAD)})"
EDGE = "[　 ,，、●※*()（）]+"


def qualifies(text: Column) -> Column:
    return text.rlike(either(ABOUT)) & ~text.rlike(either(NOT_ABOUT))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cut(text: Column) -> Column:
    """The warning without what was joined to it: other fields, other clauses, what stands behind its last ending word."""
    at = F.regexp_instr(text, F.lit(FIELD)) - 1
    text = F.when(at >= LEAST, F.substring(text, F.lit(1), at)).otherwise(text)
    clauses = F.filter(F.transform(F.split(text, rf"(?<=[。;；])|(?={MARK})"), stripped), lambda c: c != "")
    begun = F.aggregate(clauses, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), lambda s, c: F.struct(F.when(s["open"] & ((s["text"] == "") | qualifies(c)), F.concat(s["text"], c)).otherwise(s["text"]).alias("text"), (s["open"] & ((s["text"] == "") | qualifies(c))).alias("open")))
    kept = begun["text"]
    ended = F.regexp_extract(kept, rf"^([\s\S]*(?:{either(ENDINGS)})[。.）)]?)", 1)
    return F.regexp_replace(F.when(ended != "", ended).otherwise(kept), f"^{EDGE}|{EDGE}$", "")


def allergen_warnings(lines: DataFrame, key: str) -> DataFrame:
    """key, warning, allergens (sorted names that it holds): labels without a warning have no row.  lines: key, no (their order), text; a null text is empty."""
    rows = lines.select(key, "no", stripped(F.coalesce("text", F.lit(""))).alias("t")).where(~F.col("t").rlike(AMOUNTS))
    order = Window.partitionBy(key).orderBy("no")
    before = F.lag("t").over(order)
    own = F.col("t").rlike(rf"^\s*[※*]|^\s*{THEIRS}")
    goes_on = (F.col("t") != "") & ~F.col("t").rlike(HEADED) & (~before.rlike(r"[。.]$") | own)
    rows = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    whole, open_ = F.lit(""), F.lit(True)
    for step in range(1, MOST_LINES):
        open_ = open_ & F.coalesce(F.lead("goes_on", step).over(order), F.lit(False))
        whole = F.concat(whole, F.when(open_, F.lead("t", step).over(order)).otherwise(""))
    begin = F.regexp_instr("t", F.lit(OPENING))
    rows = rows.select(key, "no", "t", begin.alias("at"), whole.alias("more")).where("at > 0")
    rows = rows.where(~((F.substring("t", F.col("at"), F.lit(1)) == "含") & F.col("t").rlike(rf"\d\s*(?:{either(UNITS)})")))
    said = F.regexp_replace(F.concat(F.substring("t", F.col("at"), F.length("t")), "more"), rf"^\s*[※*●(（]*\s*(?:{either(HEADINGS)})\s*[：:]?\s*", "")
    found = rows.select(key, "no", said.alias("said")).select(key, "no", cut(F.col("said")).alias("w")).where((F.length("w") >= LEAST) & qualifies(F.col("w")))
    best = found.groupBy(key).agg(F.min_by("w", F.struct(-F.length("w"), "no")).alias("warning"))
    return best.withColumn("allergens", F.array_sort(F.array_distinct(F.regexp_extract_all("warning", F.lit(f"({either(ALLERGENS)})")))))
