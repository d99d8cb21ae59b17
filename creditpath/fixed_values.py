"""Business constants that results depend on."""

# Advertising channels with the share of touches each receives, in percent.
TOUCH_WEIGHTS = {
    "Social Network": 20,
    "Search Engine Marketing": 30,
    "Google Display Network": 15,
    "Affiliates": 30,
    "Email": 5,
}

# Cost per thousand impressions by channel, in dollars.
CPM = {
    "Social Network": 8.0,
    "Search Engine Marketing": 2.43,
    "Google Display Network": 3.12,
    "Affiliates": 20.0,
    "Email": 15.0,
}

# Cost per click by channel, in dollars.
CPC = {
    "Social Network": 0.92,
    "Search Engine Marketing": 2.62,
    "Google Display Network": 0.63,
    "Affiliates": 0.88,
    "Email": 0.91,
}

# Average order value by product stars, in dollars.
ORDER_VALUE = {
    5: 209.085,
    4: 174.2375,
    3: 69.695,
    2: 34.8475,
    1: 10.45425,
}

# Click-through curve (top rate, number of positions, width) and like curve (stars, width).
CTR_TOP = 0.12
CTR_RANKS = 10
CTR_WIDTH = 2.5
STARS = 5
LIKE_WIDTH = 2.0
CTR_LIFT = 1.3

# The campaign whose budget the spend reports divide.
CAMPAIGN_ID = "3d65f7e92e81480cac52a20dfdf64d5b"
CAMPAIGN_BUDGET = 10000.0
CAMPAIGN_SHARE = 0.2
CAMPAIGN_START = "2020-05-17 00:00:00"

# Bucket counts of the rankings, and the return on ad spend to reach.
VISIT_TILES = 100
RANK_TILES = 10
TARGET_ROAS = 0.7

# Names of the states around the channels of a journey.
START, CONVERSION, NULL = "Start", "Conversion", "Null"
