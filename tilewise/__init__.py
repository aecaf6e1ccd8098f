"""Surface-inspection analytics on Spark: tables of images, tiles, tokens and pixels."""
