"""Pieces that random texts are made of: near misses as well as hits."""

PIECES = [
    "a", "é", "😀", " ", "\n", "x.y", "-", "token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", " = ", ": ", "=", '"', "'", "abcdefghijkl", "Zz09+/_.=-", "AKIA", "AKIAABCDEFGHIJKLMN", "A1", "deadbeef", "0123456789abcdef",
    "john.doe", "@", "example", ".com", ".", "mail7.example.com", "1.2.3.4", "300.1.1.1", "10.0.0.255", "0010.0.0.1", "1", "23", "456", "4111111111111111", "4111 1111 1111 1111", "4845168114407329", "9807915762804490", "+", "+1 (017) 555-7713", "+49 30 123456", "555-", "(", ") ",
]
