"""codemill.sources"""
