"""The formula language: text to one syntax tree, and what is done with the tree."""
