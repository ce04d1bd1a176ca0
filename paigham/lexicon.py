"""Labels, tokens, word lists and keyword rules that results depend on."""

from __future__ import annotations

# Fixed values, in their natural order.
LABELS = ("Genuine", "Scam")
LABEL_SPELLINGS = {
    "scam": "Scam",
    "fraud": "Scam",
    "spam": "Scam",
    "genuine": "Genuine",
    "ham": "Genuine",
    "legit": "Genuine",
    "legitimate": "Genuine",
    "normal": "Genuine",
}
SOURCE_SPELLINGS = {"authentic": "Authentic", "real": "Authentic", "synthetic": "Synthetic", "generated": "Synthetic"}

URL_TOKEN, PHONE_TOKEN, SHORTCODE_TOKEN, NUMBER_TOKEN = "urltoken", "phonetoken", "shortcodetoken", "numtoken"
SHORT_CODES = ("8171", "786", "8000", "667", "3333", "1234")
TOP_LEVEL_DOMAINS = "com net org pk co io ly me app info xyz site page link biz online store shop club top live fun pro tk cc".split()

# Variant spelling and the standard one.
SPELLINGS = {
    "ap": "aap", "apka": "aap ka", "aapka": "aap ka", "apki": "aap ki", "aapki": "aap ki", "apke": "aap ke", "aapke": "aap ke",
    "hy": "hai", "he": "hai", "hei": "hai", "hen": "hain", "hn": "hain", "han": "hain",
    "kia": "kya", "ky": "kya",
    "krna": "karna", "krne": "karne", "kren": "karein", "karen": "karein", "krein": "karein", "kre": "karein", "kro": "karo", "kr": "kar",
    "nhi": "nahi", "nai": "nahi", "nahin": "nahi",
    "me": "mein", "mai": "mein", "mn": "mein",
    "sy": "se", "sey": "se",
    "py": "pe", "pr": "pe",
    "or": "aur", "wo": "woh", "ye": "yeh", "zuroori": "zaroori", "zarori": "zaroori", "zaruri": "zaroori", "whatsap": "whatsapp", "wtsp": "whatsapp",
    "mubarik": "mubarak", "mubarek": "mubarak", "manzor": "manzoor", "manzur": "manzoor", "ehsas": "ehsaas", "emdad": "imdad", "fori": "fauri", "foran": "fauri",
    "jldi": "jaldi", "tarikh": "tareekh", "tarik": "tareekh", "mufat": "muft",
}

# Function words that are removed.
STOPWORDS = frozenset(
    "ka ki ke ko se me mein par pe pr tak ne na ho hi bhi to tou hy "
    "hai hain hu hun hoon tha thi the thay ga gi ge gy hoga hogi honge "
    "ye yeh wo woh is us in un iss uss jo ji yah vo "
    "aur ya agar magar lekin phir fir bs bas sab kuch kch koi kai har ek do "
    "kar kare karo karna karne karta karti karte raha rahi rahe gaya gayi gaye jaye jana aa ja de le lo di dia diya "
    "the a an of for and or is are was to your you on at in it be will has have".split()
)
# Words that are never removed.
PROTECTED = frozenset(
    "free muft prize inam winner win won jeet jeeta lottery bonus reward gift offer urgent fauri abhi "
    "jaldi verify verification confirm account block blocked band close suspend loan qarza click link otp pin "
    "password cnic atm card transfer bhejain bhejo send claim activate login update expire warning alert "
    "customs parcel fee charges tax refund whatsapp emergency penalty fine reactivate unlock security "
    "balance statement transaction successful reminder due amount bill recharge package subscribe unsubscribe "
    "delivery order appointment class exam assignment meeting khana ammi abbu bhai behn "
    "jazzcash easypaisa sadapay nayapay jazz telenor ufone zong hbl ubl meezan bisp ehsaas bank "
    "urltoken phonetoken numtoken shortcodetoken".split()
)

# Keyword categories of the risk rule, its levels, and the words of the expected-label heuristic.
RISK_KEYWORDS = {
    "urgency": ("urgent", "jaldi", "immediately", "alert"),
    "prize": ("mubarak", "winner", "lottery", "prize"),
    "money": ("paise", "rupees", "lakh", "payment"),
    "verification": ("verify", "otp", "password", "confirm"),
    "bank": ("bank", "account", "atm", "debit"),
    "links": ("http", "www", "bit.ly", "click"),
}
RISK_LEVELS = ("LOW", "LOW-MEDIUM", "MEDIUM", "HIGH", "CRITICAL")
EXPECTED_SCAM_WORDS = ("mubarak", "prize", "urgent", "verify", "free", "lakh", "lottery")


def stopwords(extra: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> frozenset[str]:
    """The active stoplist: base and extra words, without kept ones; protected words always stay in the text."""
    lower = lambda words: {w.lower() for w in words}
    return frozenset((STOPWORDS | lower(extra)) - lower(keep) - PROTECTED)
