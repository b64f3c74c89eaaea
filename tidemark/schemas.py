"""Explicit schemas of inputs and tables; nothing is inferred."""

RAW_TRADES = ("timestamp", "outcomeId", "marketId", "contractSeries", "league", "marketType", "tradeType", "legs", "cost", "qty", "side")
TRADES = "ts timestamp, row_num int, outcome_id string, market_id string, contract_series string, league string, market_type string, trade_type string, legs smallint, cost double, qty double, price double, side string, taker_count smallint, ambiguous boolean"
STORED_TRADES = f"source string, file_date date, {TRADES}"
TRADE_FILES = "file_date date, etag string, size_bytes bigint, row_count int, downloaded_at timestamp, loaded_at timestamp"
POSTS = "post_id bigint, account string, text string, t0 timestamp, created_at timestamp, is_retweet boolean, is_quote boolean, raw string, scraped_via string, fetched_at timestamp, deleted_at timestamp"
CLASSIFICATIONS = "post_id bigint, model string, model_version string, sport string, team string, players array<string>, status_change string, template string, detail struct<injuries:array<string>,source:string,week:int,preseason:boolean>, classified_at timestamp, reviewed_label string"
EVENTS = "event_id string, sport string, league string, status string, description string, starts_at timestamp, synced_at timestamp"
MARKETS = "market_id string, event_id string, market_type string, strike string, status string, description string, outcomes array<struct<outcomeId:string,name:string>>, synced_at timestamp"
RESOLUTIONS = "post_id bigint, model_version string, subject string, status string, reason string, event_id string, team string, tier1 boolean, market_ids array<string>, resolved_at timestamp"
POST_ITEM = "id string, fullText string, text string, createdAt string, isRetweet boolean, isQuote boolean, author struct<userName:string>"
RUN_LEDGER = "account string, since string, until string, run_id string, status string, items int, unique_posts int, other_authors map<string,int>, cost_usd double, charged_events map<string,int>, complete_week boolean, started_at string"
RUN_PRICING = "chargedEventCounts map<string,int>, pricingInfo struct<pricingPerEvent:struct<actorChargeEvents:map<string,struct<eventPriceUsd:double,eventTieredPricingUsd:map<string,struct<tieredEventPriceUsd:double>>>>>>, usageTotalUsd double"
JOURNAL = "ts bigint, kind string, slot int, slots int, conn string, market string, channel string, expected bigint, got bigint, events array<string>, detail string"
STREAM = "recv_ts bigint, conn string, msg struct<ts:bigint,nonce:bigint,code:string,message:string,snapshot:map<string,struct<eventId:string,book:struct<seq:bigint>,lifecycle:struct<seq:bigint,status:string>>>,delta:map<string,struct<eventId:string,book:struct<seq:bigint>,lifecycle:struct<seq:bigint,status:string>>>>"
ROSTER = "map<string,struct<team:string,full_name:string>>"
CATALOG = "eventId string, league string, status string, description string, startsTs bigint"
WINDOWS = "start bigint, `end` bigint, scope string, slot int, events array<string>, market string, cause string"
