"""Canonical column names and the fixed values the data model uses."""

# Column names of the delivered CSV families -> canonical names.
TRACKING_NAMES = {
    "GameID": "game_id",
    "Frame": "frame",
    "HA": "ha",
    "No": "no",
    "X": "x",
    "Y": "y",
}
PLAY_NAMES = {
    "試合ID": "game_id",
    "攻撃履歴No": "attack_no",
    "フレーム番号": "frame",
    "選手名": "player_name",
    "選手背番号": "shirt_no",
    "ホームアウェイF": "ha",
    "チームID": "team_id",
    "アクション名": "action_name",
}
PLAYERS_NAMES = {
    "試合ID": "game_id",
    "ホームアウェイF": "ha",
    "背番号": "shirt_no",
    "選手ID": "player_id",
    "選手名": "player_name",
}

# Canonical types; whole numbers are LONG for ids and frames, INT for sides and shirt numbers.
TRACKING_TYPES = {"game_id": "bigint", "frame": "bigint", "ha": "int", "no": "int", "x": "double", "y": "double"}
PLAY_TYPES = {
    "game_id": "bigint",
    "attack_no": "bigint",
    "frame": "bigint",
    "player_name": "string",
    "shirt_no": "int",
    "ha": "int",
    "team_id": "bigint",
    "action_name": "string",
}
PLAYERS_TYPES = {"game_id": "bigint", "ha": "int", "shirt_no": "int", "player_id": "bigint", "player_name": "string"}

# Fixed values of the scene layout.
BALL_HA, BALL_NO = 0, 0
MAX_PLAYERS = 22
SLOTS = 23
SOURCE_FPS = 25
SUBSTITUTION_MARKER = "交代"
VECTOR_WIDTH = 256
TEMPERATURE = 0.07

ATTACK = ["game_id", "attack_no"]
ENTITY = ["ha", "no"]
