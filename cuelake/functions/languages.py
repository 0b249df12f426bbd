"""The languages that captions come in, as a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Code, English name, native name.
LANGUAGES = """
zh|Chinese (Simplified)|简体中文
zh-TW|Chinese (Traditional)|繁體中文
ja|Japanese|日本語
ko|Korean|한국어
hi|Hindi|हिन्दी
bn|Bengali|বাংলা
ta|Tamil|தமிழ்
th|Thai|ไทย
vi|Vietnamese|Tiếng Việt
id|Indonesian|Bahasa Indonesia
ms|Malay|Bahasa Melayu
tl|Filipino|Filipino
my|Burmese|မြန်မာ
en|English|English
es|Spanish|Español
fr|French|Français
de|German|Deutsch
pt|Portuguese|Português
pt-BR|Portuguese (Brazilian)|Português (Brasil)
it|Italian|Italiano
nl|Dutch|Nederlands
ca|Catalan|Català
sv|Swedish|Svenska
da|Danish|Dansk
no|Norwegian|Norsk
fi|Finnish|Suomi
is|Icelandic|Íslenska
ru|Russian|Русский
uk|Ukrainian|Українська
pl|Polish|Polski
cs|Czech|Čeština
sk|Slovak|Slovenčina
ro|Romanian|Română
hu|Hungarian|Magyar
bg|Bulgarian|Български
hr|Croatian|Hrvatski
sr|Serbian|Српски
el|Greek|Ελληνικά
tr|Turkish|Türkçe
ar|Arabic|العربية
fa|Persian|فارسی
he|Hebrew|עברית
ur|Urdu|اردو
sw|Swahili|Kiswahili
am|Amharic|አማርኛ
"""


def languages(spark: SparkSession) -> DataFrame:
    rows = [tuple(line.split("|")) for line in LANGUAGES.strip().split("\n")]
    return spark.createDataFrame(rows, "code string, english string, native string")


def find_language(rows: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """``rows`` with the code that ``name`` means: a code, an English or a native name, in any case; null if unknown."""
    table = languages(spark)
    keys = table.select("code", F.explode(F.array_distinct(F.array(*(F.lower(c) for c in ("code", "english", "native"))))).alias("key"))
    keys = keys.groupBy("key").agg(F.min("code").alias("language_code"))  # 135 keys at most
    return rows.join(F.broadcast(keys), F.lower(F.col(name)) == F.col("key"), "left").drop("key")


def is_supported(code: Column) -> Column:
    return code.isin([line.split("|")[0] for line in LANGUAGES.strip().split("\n")])
