"""Languages by code: the table of ISO 639-1, and the look-up of display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The codes of ISO 639-1 with their English display names.
ISO_639_1 = """
aa Afar
ab Abkhazian
ae Avestan
af Afrikaans
ak Akan
am Amharic
an Aragonese
ar Arabic
as Assamese
av Avaric
ay Aymara
az Azerbaijani
ba Bashkir
be Belarusian
bg Bulgarian
bh Bihari
bi Bislama
bm Bambara
bn Bangla
bo Tibetan
br Breton
bs Bosnian
ca Catalan
ce Chechen
ch Chamorro
co Corsican
cr Cree
cs Czech
cu Church Slavic
cv Chuvash
cy Welsh
da Danish
de German
dv Divehi
dz Dzongkha
ee Ewe
el Greek
en English
eo Esperanto
es Spanish
et Estonian
eu Basque
fa Persian
ff Fulah
fi Finnish
fj Fijian
fo Faroese
fr French
fy Western Frisian
ga Irish
gd Scottish Gaelic
gl Galician
gn Guarani
gu Gujarati
gv Manx
ha Hausa
he Hebrew
hi Hindi
ho Hiri Motu
hr Croatian
ht Haitian Creole
hu Hungarian
hy Armenian
hz Herero
ia Interlingua
id Indonesian
ie Interlingue
ig Igbo
ii Sichuan Yi
ik Inupiaq
io Ido
is Icelandic
it Italian
iu Inuktitut
ja Japanese
jv Javanese
ka Georgian
kg Kongo
ki Kikuyu
kj Kuanyama
kk Kazakh
kl Kalaallisut
km Khmer
kn Kannada
ko Korean
kr Kanuri
ks Kashmiri
ku Kurdish
kv Komi
kw Cornish
ky Kyrgyz
la Latin
lb Luxembourgish
lg Ganda
li Limburgish
ln Lingala
lo Lao
lt Lithuanian
lu Luba-Katanga
lv Latvian
mg Malagasy
mh Marshallese
mi Maori
mk Macedonian
ml Malayalam
mn Mongolian
mr Marathi
ms Malay
mt Maltese
my Burmese
na Nauru
nb Norwegian Bokmål
nd North Ndebele
ne Nepali
ng Ndonga
nl Dutch
nn Norwegian Nynorsk
no Norwegian
nr South Ndebele
nv Navajo
ny Nyanja
oc Occitan
oj Ojibwa
om Oromo
or Odia
os Ossetic
pa Punjabi
pi Pali
pl Polish
ps Pashto
pt Portuguese
qu Quechua
rm Romansh
rn Rundi
ro Romanian
ru Russian
rw Kinyarwanda
sa Sanskrit
sc Sardinian
sd Sindhi
se Northern Sami
sg Sango
si Sinhala
sk Slovak
sl Slovenian
sm Samoan
sn Shona
so Somali
sq Albanian
sr Serbian
ss Swati
st Southern Sotho
su Sundanese
sv Swedish
sw Swahili
ta Tamil
te Telugu
tg Tajik
th Thai
ti Tigrinya
tk Turkmen
tl Tagalog
tn Tswana
to Tongan
tr Turkish
ts Tsonga
tt Tatar
tw Twi
ty Tahitian
ug Uyghur
uk Ukrainian
ur Urdu
uz Uzbek
ve Venda
vi Vietnamese
vo Volapük
wa Walloon
wo Wolof
xh Xhosa
yi Yiddish
yo Yoruba
za Zhuang
zh Chinese
zu Zulu
"""


def iso_languages() -> list[tuple[int, str, str]]:
    """(place, display name, code) of the standard's languages."""
    rows = [line.split(" ", 1) for line in ISO_639_1.strip().splitlines()]
    return [(place, name, code) for place, (code, name) in enumerate(rows)]


def language_table(spark: SparkSession) -> DataFrame:
    """``ord, name, code`` of the standard's languages."""
    return spark.createDataFrame(iso_languages(), "ord int, name string, code string")


def with_language_code(rows: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Look up the code of each row's language by display name, in any case; NULL if unknown.

    ``languages`` has ``ord, name, code``, by default those of the standard; the first of equal names counts.
    """
    if languages is None:
        languages = language_table(rows.sparkSession)
    first = (
        languages.groupBy(F.lower("name").alias("language_key"))
        .agg(F.min(F.struct("ord", "code")).alias("first"))
        .select("language_key", F.col("first.code").alias("code"))
    )
    return (
        rows.withColumn("language_key", F.lower("language"))
        .join(first, "language_key", "left")
        .drop("language_key")
    )
