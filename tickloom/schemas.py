"""Schemas of the records that come in from outside."""

RAW_TRADE = "e string, E long, s string, t long, p string, q string, b long, a long, T long, m boolean, M boolean"
#: The same with names that differ in more than case, as sources and sessions are not case-sensitive by default.
TRADE_EVENT = "event_type string, event_time_ms long, symbol string, trade_id long, price string, quantity string, buyer_order_id long, seller_order_id long, trade_time_ms long, is_buyer_maker boolean"
RAW_NEWS = "source string, article_id string, title string, content string, url string, published_at string, crawled_at string, author string, tags array<string>, content_hash string"
REST_TRADE = "id long, price string, qty string, time long, isBuyerMaker boolean, isBestMatch boolean"
TICKER = "symbol string, lastPrice string, highPrice string, lowPrice string, openPrice string, volume string, quoteVolume string, count long, priceChangePercent string"
LEVELS = "array<struct<price: double, quantity: double>>"
#: Exact products: (18,8) times (18,8) is (37,16); wider factors would lose scale.
MONEY = "decimal(18,8)"
