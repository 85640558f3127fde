"""The query dialect: lexer, syntax tree and parser."""
