"""Schemas of landed records and of the stored tables."""

from __future__ import annotations

RAW_APP = """
    trackId bigint, bundleId string, trackName string, sellerName string, description string,
    genres array<string>, primaryGenreName string, averageUserRating double,
    userRatingCount bigint, price double, advisories array<string>,
    currentVersionReleaseDate string, releaseDate string, languageCodesISO2A array<string>,
    contentAdvisoryRating string
"""

APP = """
    struct<track_id: bigint, title: string, subtitle: string, seller: string,
           primary_genre: string, genres: array<string>, rating: double, rating_count: bigint,
           price: double, is_paid: boolean, is_monetized: boolean,
           days_since_update: int, age_days: int, languages: array<string>>
"""

RAW_POPULARITY = """
    searchTerm string, countryOrRegion string, genre string, week string, month string,
    rankInGenre int, searchPopularityInGenre int, searchPopularity1to100 int, searchPopularity1to5 int
"""

POPULARITY = """
    term string, country string, genre string, period date, granularity string,
    rank_in_genre int, pop_in_genre int, pop_1to100 int, pop_1to5 int, pulled_at timestamp
"""

METRIC = "track_id bigint, storefront string, day date, rating double, rating_count bigint"
