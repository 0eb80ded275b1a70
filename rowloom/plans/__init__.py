"""Recipes: ordered lists of operations folded into one lazy plan."""
