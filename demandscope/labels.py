"""Human-readable text that is part of stored results."""

# Score notes ({n} is a count).
NOTE_STALE = "/10 в топе не обновлялись больше года"
NOTE_NO_LOCAL = "/5 из топа без локализации"
NOTE_IRRELEVANT = "топ-1 слабо релевантен запросу — Apple не нашёл ничего лучше"
NOTE_THIN = "топ-3 тонкий по отзывам"
NOTE_PAID = "/10 в топе платные — спрос платежеспособен"
NOTE_WATCH = "лидер силён — следим за деградацией рейтинга"
NOTE_NONE = "прошёл гейты, но явных признаков слабости топа нет — слабый кандидат"
LEADING_FACTOR = {
    "weakness": "топ уязвим по совокупности признаков",
    "market": "ниша с подтверждённым трафиком, но топ крепкий",
    "demand_proxy": "запрос высоко в автокомплите",
    "coherence": "запрос точно совпадает с нишей",
}

LEADING_FACTOR_MARK = " (ведущий фактор: "

# Score bands.
BAND_STRONG, BAND_MEDIUM, BAND_WEAK = "сильный", "средний", "слабый"

# Rating signals, flags, and brand signals.
SIGNAL_DEMAND, SIGNAL_ROOM, SIGNAL_MARKET = "спрос", "место", "рынок"
SIGNAL_CLUSTER, SIGNAL_CLEAN = "кластер", "точность"
FLAG_BRAND, FLAG_STALE = "бренд?", "топ устарел"
BRAND_BY_TITLE, BRAND_BY_SELLER, BRAND_BY_FIRST_WORD = "название", "разработчик", "первое слово"

# Evidence told by a rating signal.
TOLD_PLACE, TOLD_METADATA, TOLD_NOTHING = "автокомплит #", "в метаданных у ", "нет данных"
TOLD_STALE, TOLD_NO_LEADER = "/10 заброшены", ", точного лидера нет"
TOLD_THOUSANDS, TOLD_REVIEWS = "k отзывов у лидера", " отзывов"
TOLD_QUERIES, TOLD_COHERENCE = " запросов", "связность "
REASON_NONE, REASON_MISSING = "нет сильных признаков", " · не хватает: "

# Movement strength.
STRENGTH_NEW, STRENGTH_SUSTAINED = "новичок", "устойчивый рост"
STRENGTH_UP, STRENGTH_DOWN, STRENGTH_STABLE = "рост", "падение", "стабильно"

# An alert of the weekly report.
ALERT_RATING, ALERT_CHANCE = ": рейтинг ", " — окно на перехват"

# Trend arrows.
UP, DOWN, FLAT, NONE = "↑", "↓", "→", "·"
