"""What items of an ingredient list look like, and what blocks of label text are none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.texts import half_width

# Words that no ingredient holds: of addresses and companies, dates and storage, nutrition tables, and the rest of a label.
ELSEWHERE = [
    "www", "http", "@", "公司", "企業", "工廠", "廠址", "地址", "電話", "專線", "信箱", "網址", "服務", "客服",
    "臺灣", "台灣", "縣", "市", "區", "鄉", "鎮", "村", "里", "路", "街", "號", "樓", "段", "巷", "弄",
    "日期", "期限", "保存", "冷藏", "冷凍", "開封", "食用", "微波", "加熱", "請", "勿", "注意", "警告", "建議",
    "營養", "標示", "熱量", "蛋白質", "脂肪", "碳水", "每份", "公克", "毫克", "毫升", "大卡", "份量",
    "過敏", "生產線", "製造", "產地", "品名", "淨重", "內容量", "内容量", "統一編號", "條碼",
    "本產品", "本包裝", "沉澱", "現象", "品質", "風味絕佳", "美味",
]
LONG_RUNS = [r"\d{3,}", "[A-Za-z]{4,}"]
# Words of a nutrition table, and of an address or a company.
NUTRITION = ["大卡", "公克", "毫克", "kcal", "熱量", "蛋白質", "飽和脂肪", "反式脂肪", "碳水化合物", "膳食纖維", "每100", "每一份量", "本包裝含"]
ADDRESS = ["股份有限公司", "有限公司", "企業社", "服務專線", "客服", "網址", r"www\.", "地址", "臺灣", "台灣", "市.{0,6}區", "鄉", "鎮", "號$"]
HAN = "[^一-鿿]"


def letters(item: Column) -> Column:
    """How many letters and digits an item has."""
    return F.length(F.regexp_replace(half_width(item), r"[^\p{L}\p{N}]", ""))


def han_share(item: Column) -> Column:
    """The share of Chinese characters among those that are not blanks; 0 for blanks only."""
    return F.length(F.regexp_replace(item, HAN, "")) / F.greatest(F.length(F.replace(item, F.lit(" "), F.lit(""))), F.lit(1))


def looks_like_item(item: Column) -> Column:
    """1 to 60 letters, none of the words from elsewhere, Chinese for the most part or with a bracket; false for null."""
    shaped = letters(item).between(1, 60) & ((han_share(item) > 0.5) | item.rlike("[(（]"))
    return F.coalesce(shaped & ~item.rlike("|".join([*LONG_RUNS, *ELSEWHERE])), F.lit(False))


def strict_item(item: Column) -> Column:
    """Looks like an item, in at most eight letters and without a blank inside."""
    return looks_like_item(item) & (letters(item) <= 8) & ~F.contains(F.regexp_replace(item, r"^\s+|\s+$", ""), F.lit(" "))


def plausible(items: Column) -> Column:
    """How much items look like a list: 1 for 2 to 12 letters that are Chinese for the most part, -2 for more than 40, -1 for hardly any Chinese; null for none."""
    rated = F.transform(items, lambda x: F.struct(letters(x).alias("n"), han_share(x).alias("share")))
    points = lambda s: (
        F.when(s["n"] == 0, 0).when(s["n"].between(2, 12) & (s["share"] > 0.6), 1).when(s["n"] > 40, -2).when(s["share"] < 0.3, -1).otherwise(0)
    )
    return F.when(F.size(items) > 0, F.aggregate(rated, F.lit(0), lambda a, s: a + F.coalesce(points(s), F.lit(0))))


def junk(block: Column, known: Column) -> Column:
    """A block of text that holds no ingredient: no name that is known, and three words of a nutrition table among many digits, or two of an address."""
    text = F.coalesce(block, F.lit(""))
    digits = F.length(F.regexp_replace(text, r"\P{Nd}", "")) / F.greatest(F.length(text), F.lit(1))
    table = (F.regexp_count(text, F.lit("|".join(NUTRITION))) >= 3) & (digits > 0.15)
    return ~F.coalesce(known, F.lit(False)) & (table | (F.regexp_count(text, F.lit("|".join(ADDRESS))) >= 2))
