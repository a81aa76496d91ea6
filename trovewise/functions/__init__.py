"""Column functions: analysis of texts, stemming, mark-up, scoring."""
